"""DuckDB SQL of the registered queries; the views are derived as in views.py.

Without SQL are those that depend on the order of decisions or on distances between
characters, which DuckDB counts in bytes; tests hold them against brute force.
"""

from __future__ import annotations

SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
SPACES = r"'^\s+|\s+$'"

VIEWS = {
    "papers": r"""
        SELECT doc_id, 'p' || doc_id AS id, regexp_extract(text, '^[^.\n]{0,120}') AS title, doc_id % 4 + 1 AS n_authors,
          CASE WHEN doc_id % 7 <> 0 THEN text END AS abstract_text,
          CASE WHEN doc_id % 11 <> 0 THEN DATE '2015-01-01' + CAST(doc_id % 3000 AS INTEGER) END AS publication_date,
          CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 4 = 1 THEN 'https://doi.org/' ELSE '' END || '10.1/AB' || (doc_id // 2) END AS doi,
          CASE WHEN doc_id % 4 <> 0 THEN ['http://x/' || (doc_id % 10), 'http://y/' || (doc_id // 2)] ELSE [] END AS urls,
          CASE WHEN doc_id % 5 <> 0 THEN (doc_id * 37) % 1000 END AS cited_by_count,
          ['arxiv', 'openalex', 'semantic_scholar', 'crossref', 'europe_pmc', 'core'][doc_id % 6 + 1] AS source,
          [0.8, 0.9, 1.0, 0.6, 0.7, 0.5][doc_id % 6 + 1] AS weight, doc_id // 6 AS rank
        FROM documents""",
    "placed": """
        SELECT *, lower(replace(doi, 'https://doi.org/', '')) AS doi_key,
          row_number() OVER (ORDER BY weight DESC, rank, id) AS pos FROM papers""",
    "merged": """
        SELECT doi_key, arg_min(id, pos) AS id, arg_max(title, strlen(title) * 1000000000 + pos) AS title,
          max(n_authors) AS n_authors, max(strlen(abstract_text)) AS abstract_bytes,
          arg_max(abstract_text, strlen(abstract_text) * 1000000000 + pos) AS abstract_text,
          arg_min(publication_date, pos) FILTER (publication_date IS NOT NULL) AS publication_date, arg_min(doi, pos) AS doi,
          max(cited_by_count) AS cited_by_count, array_to_string(list_sort(list(DISTINCT source)), '+') AS source,
          sum(weight / (60 + rank + 1)) AS rrf, list(urls ORDER BY pos) AS url_lists
        FROM placed WHERE doi_key IS NOT NULL GROUP BY doi_key""",
    "catalog": """
        SELECT 'd' || doc_id AS stem, doc_id AS i, n_chars AS file_size_bytes,
          CASE WHEN doc_id % 9 <> 0 THEN 'Title ' || doc_id END AS title,
          CASE WHEN doc_id % 3 <> 0 THEN '10.1/AB' || (doc_id // 2) END AS doi,
          CASE WHEN doc_id % 8 <> 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' END AS downloaded_at,
          CASE WHEN doc_id % 10 = 0 THEN 'markdown/d' || doc_id || '.md'
               WHEN doc_id % 10 <> 1 THEN 'markdown/' || substr('d' || doc_id, 1, 2) || '/d' || doc_id || '.md' END AS markdown_path,
          doc_id % 6 <> 0 AS has_conversion, doc_id % 6 <> 0 AND coalesce(quality = 0, false) AS failed,
          doc_id % 6 <> 0 AND doc_id % 4 <> 1 AS has_embedding, doc_id % 7 AS chunks,
          doc_id % 4 = 1 AND doc_id % 12 <> 5 AS has_skip,
          CASE WHEN doc_id % 8 = 1 THEN 'embed_failed: memory' ELSE 'zero_chunks' END AS skip_reason, doc_id % 50 = 0 AS has_repair
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "objects": """
        SELECT 'papers/' || substr('d' || doc_id, 1, 2) || '/d' || doc_id || '.pdf' AS key FROM documents WHERE doc_id % 7 <> 0
        UNION ALL SELECT 'papers/' || substr('d' || doc_id, 1, 2) || '/d' || doc_id || '.html' FROM documents WHERE doc_id % 5 = 0
        UNION ALL SELECT 'papers/' || substr('d' || doc_id, 1, 2) || '/._d' || doc_id || '.pdf' FROM documents WHERE doc_id % 20 = 0
        UNION ALL SELECT 'papers/zz/x' || doc_id || '.pdf' FROM documents WHERE doc_id % 25 = 0
        UNION ALL SELECT 'markdown/' || substr('d' || doc_id, 1, 2) || '/d' || doc_id || '.md' FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 13 <> 0
        UNION ALL SELECT 'markdown/d' || doc_id || '.md' FROM documents WHERE doc_id % 10 = 0
        UNION ALL SELECT 'markdown/zz/x' || doc_id || '.md' FROM documents WHERE doc_id % 30 = 0""",
    "files": """
        SELECT key, regexp_extract(key, '[^/]*$') AS name, regexp_extract(key, '([^/]*)[.][^.]*$', 1) AS stem, regexp_extract(key, '[.]([^.]*)$', 1) AS ext,
          length(key) - length(replace(key, '/', '')) AS depth FROM objects WHERE NOT starts_with(regexp_extract(key, '[^/]*$'), '._')""",
    "sources": "SELECT stem, max(ext) AS source_ext FROM files WHERE ext IN ('pdf', 'html') GROUP BY stem",
    "md": "SELECT stem, arg_min(key, (100 - depth) || key) AS key FROM files WHERE ext = 'md' GROUP BY stem",
    "indexed": """
        SELECT 'd' || doc_id AS doc_id FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 4 <> 1 AND doc_id % 17 <> 0
        UNION ALL SELECT 'gone' || doc_id FROM documents WHERE doc_id % 40 = 0""",
    "markdown": f"SELECT conv_id, string_agg(coalesce(text, ''), {SEP} ORDER BY turn, text) AS markdown FROM conversations GROUP BY conv_id",
    "boxes": """
        SELECT CAST(l_orderkey AS VARCHAR) AS doc, l_partkey % 40 + 0.0::DOUBLE AS x1, l_suppkey % 30 + 0.0::DOUBLE AS y1, l_partkey % 40 + l_quantity AS x2, l_suppkey % 30 + l_quantity AS y2,
          l_discount AS confidence, ['text', 'table', 'reference', 'reference_content', 'display_formula', 'image', 'header'][l_partkey % 7 + 1] AS class_name, l_linenumber AS unique_id
        FROM lineitem""",
    "plain": r"SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents",
    "history": """
        SELECT 'Download' AS activity, stem, coalesce(title, stem) AS name, coalesce(CAST(file_size_bytes AS VARCHAR), '') AS detail, downloaded_at AS "at" FROM catalog WHERE downloaded_at IS NOT NULL
        UNION ALL SELECT 'Convert', stem, coalesce(title, stem), CASE WHEN failed THEN 'FAILED: repetition_loop (' || (i % 5 + 1) || 'pg ' || printf('%.1f', (i % 50) / 10.0) || 's)' ELSE (i % 5 + 1) || 'pg ' || printf('%.1f', (i % 50) / 10.0) || 's' END,
          '2024-02-' || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' FROM catalog WHERE has_conversion
        UNION ALL SELECT 'Embed', stem, coalesce(title, stem), chunks || ' chunks', '2024-03-' || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' FROM catalog WHERE has_embedding AND chunks > 0
        UNION ALL SELECT 'EmbedSkip', stem, coalesce(title, stem), skip_reason, '2024-03-' || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' FROM catalog WHERE has_skip""",
}
_NEEDS = {
    "placed": ["papers"], "merged": ["papers", "placed"], "files": ["objects"], "sources": ["objects", "files"], "md": ["objects", "files"], "history": ["catalog"],
}


def _with(views: str, body: str) -> str:
    names: list[str] = []
    for v in views.split():
        for n in [*_NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " if names else "") + body


def _relevance(title: str, abstract: str, doi: str, date: str) -> str:
    terms = ["the", "and", "of"]
    phrase = "the and of"
    low, a = f"lower({title})", f"lower(coalesce({abstract}, ''))"
    both = f"({low} || ' ' || {a})"
    hits = lambda x: "(" + " + ".join(f"CAST(contains({x}, '{t}') AS INTEGER)" for t in terms) + ")"
    n = f"len(regexp_extract_all({title}, '\\S+'))"
    return (
        f"(0.4 * {hits(both)} / 3 + 0.3 * (CASE WHEN contains({low}, '{phrase}') THEN 1.0 WHEN contains({a}, '{phrase}') THEN 0.5 ELSE 0 END)"
        f" + 0.2 * (CASE WHEN {n} > 0 THEN {hits(low)} * 1.0::DOUBLE / {n} ELSE 0 END)"
        f" + 0.1 * (CAST({abstract} IS NOT NULL AS INTEGER) * 0.5 + CAST({doi} IS NOT NULL AS INTEGER) * 0.25 + CAST({date} IS NOT NULL AS INTEGER) * 0.25))"
    )


_IOU_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
_ROUTE = "CASE WHEN class_name = 'table' THEN 'table' WHEN class_name = 'display_formula' THEN 'formula' WHEN class_name = 'image' THEN 'figure' WHEN class_name = 'header' THEN 'skip' ELSE 'text' END"
_QUALITY = r"""
    chars AS (SELECT doc_id, any_value(t) AS t, max(c) AS top FROM (SELECT doc_id, any_value(t) AS t, ch, count(*) AS c FROM (SELECT doc_id, t, unnest(string_split(regexp_replace(t, '\s+', '', 'g'), '')) AS ch FROM plain) WHERE ch <> '' GROUP BY doc_id, ch) GROUP BY doc_id),
    ws AS (SELECT doc_id, t, regexp_extract_all(t, '\S+') AS w FROM plain),
    grams AS (SELECT doc_id, max(c) * 1.0::DOUBLE / sum(c) AS top FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS g FROM ws WHERE len(w) >= 8) GROUP BY doc_id, g) GROUP BY doc_id),
    q AS (SELECT ws.doc_id, length(regexp_replace(ws.t, '\s+', '', 'g')) AS non_ws, coalesce(chars.top * 1.0::DOUBLE / nullif(strlen(ws.t), 0), 0) AS char_share,
      CASE WHEN len(w) >= 20 THEN len(list_distinct(w)) * 1.0::DOUBLE / len(w) ELSE 1.0 END AS diversity, coalesce(grams.top, 0) AS gram
      FROM ws LEFT JOIN chars USING (doc_id) LEFT JOIN grams USING (doc_id)),
    r AS (SELECT *, CASE WHEN non_ws < 50 THEN 'too_short' WHEN char_share > 0.30 THEN 'dominant_char' WHEN diversity < 0.10 THEN 'low_diversity' WHEN gram > 0.50 THEN 'dominant_ngram' END AS reject_reason FROM q)
"""
_REPAIR = """
    orphan AS (SELECT stem FROM sources WHERE stem NOT IN (SELECT stem FROM catalog)),
    nomd AS (SELECT stem FROM catalog WHERE has_conversion AND NOT failed AND stem NOT IN (SELECT stem FROM md)),
    phantom AS (SELECT stem FROM catalog WHERE stem NOT IN (SELECT stem FROM md) AND stem NOT IN (SELECT stem FROM sources)),
    flags AS (SELECT stem FROM catalog WHERE NOT failed AND ((NOT has_conversion AND stem IN (SELECT stem FROM md)) OR (downloaded_at IS NULL AND stem IN (SELECT stem FROM sources)))),
    paths AS (SELECT stem FROM catalog JOIN md USING (stem) WHERE coalesce(markdown_path, '') <> key),
    stuck AS (SELECT stem FROM catalog JOIN sources USING (stem) WHERE NOT has_conversion)
"""
_CLASS = """SELECT md.stem, CASE WHEN x.doc_id IS NOT NULL AND coalesce(has_embedding, false) THEN 'ok' WHEN x.doc_id IS NOT NULL THEN 'stamp_missing'
    WHEN coalesce(failed, false) OR coalesce(has_skip AND NOT starts_with(skip_reason, 'embed_failed'), false) THEN 'ok' ELSE 'embed_missing' END AS class
    FROM md LEFT JOIN (SELECT DISTINCT doc_id FROM indexed) x ON x.doc_id = md.stem LEFT JOIN catalog USING (stem)"""
_COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6)"
_Q0 = "(SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) q"

ORACLE: dict[str, str] = {
    "vector_topk_filtered": f"SELECT vec_id, label, {_COSINE} AS score FROM embeddings e, {_Q0} WHERE label < 5 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.v) DESC, vec_id LIMIT 10",
    "vector_knn_by_label": f"SELECT label, rank, vec_id, round(s, 6) AS score FROM (SELECT label, vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS s, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.v) DESC, vec_id) AS rank FROM embeddings e, {_Q0}) WHERE rank <= 3",
    "facet_docs": "SELECT l_orderkey, count(*) AS n_chunks FROM lineitem GROUP BY l_orderkey",
    "distinct_docs": "SELECT count(DISTINCT l_orderkey) AS n_docs, count(*) AS n_points FROM lineitem",
    "vector_delete_docs": "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "doi_matches": _with("placed", "SELECT doi_key, count(*) AS n_papers, arg_min(id, pos) AS first_id FROM placed WHERE doi_key IS NOT NULL GROUP BY doi_key"),
    "merge_fields": _with(
        "merged",
        "SELECT doi_key, id, title, n_authors, abstract_bytes, CAST(publication_date AS VARCHAR) AS publication_date, doi, "
        "coalesce(array_to_string(list_filter(flatten(url_lists), lambda x, i: list_position(flatten(url_lists), x) = i), ' '), '') AS urls, cited_by_count, source, round(rrf, 6) AS rrf FROM merged",
    ),
    "blended_score": _with(
        "merged",
        f"SELECT doi_key, round(rel, 6) AS relevance, round(0.4 * rrf + 0.35 * rel + 0.25 * ln(1 + coalesce(cited_by_count, 0)) / ln(10001), 6) AS score FROM (SELECT *, {_relevance('title', 'abstract_text', 'doi', 'publication_date')} AS rel FROM merged)",
    ),
    "relevance_score": _with("papers", f"SELECT id, round({_relevance('title', 'abstract_text', 'doi', 'publication_date')}, 6) AS relevance FROM papers"),
    "title_quality": _with("papers", f"SELECT id, title FROM papers WHERE strlen(regexp_replace(title, {SPACES}, '', 'g')) > 10"),
    "min_citations": _with("papers", "SELECT id, cited_by_count FROM papers WHERE cited_by_count IS NULL OR cited_by_count >= 500"),
    "normalized_titles": _with(
        "papers",
        r"SELECT array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(title), '[^\p{L}\p{N}\s]', '', 'g'), '\S+'), lambda w: w NOT IN ('the', 'a', 'an')), ' ') AS title_key, count(*) AS n FROM papers GROUP BY 1",
    ),
    "date_filter_papers": _with("papers", "SELECT id, CAST(publication_date AS VARCHAR) AS publication_date FROM papers WHERE publication_date >= DATE '2016-07-01' AND publication_date < DATE '2020-01-01'"),
    "date_filter_orders": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1994-01-01' AND CAST(o_orderdate AS DATE) < DATE '1995-07-01' GROUP BY 1",
    "year_filter_orders": "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY 1",
    "downloadable_papers": _with("papers", "SELECT source, count(*) AS n FROM papers WHERE len(urls) > 0 OR doi IS NOT NULL GROUP BY source"),
    "quality_measures": _with("plain", "").rstrip() + ", " + _QUALITY + "SELECT doc_id, non_ws, round(char_share, 6) AS char_share, round(diversity, 6) AS diversity FROM q",
    "quality_reasons": _with("plain", "").rstrip() + ", " + _QUALITY + "SELECT doc_id, reject_reason FROM r",
    "quality_tally": _with("plain", "").rstrip()
    + ", "
    + _QUALITY
    + "SELECT count(*) FILTER (reject_reason IS NULL) AS accepted, count(*) FILTER (reject_reason = 'too_short') AS too_short, count(*) FILTER (reject_reason = 'dominant_char') AS dominant_char, count(*) FILTER (reject_reason = 'low_diversity') AS low_diversity, count(*) FILTER (reject_reason = 'dominant_ngram') AS dominant_ngram FROM r",
    "repetition_char_runs": "WITH c AS (SELECT doc_id, ch, i FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents)), "
    "g AS (SELECT doc_id, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM c), "
    "n AS (SELECT doc_id, count(*) AS len FROM g GROUP BY doc_id, ch, run), "
    "s AS (SELECT doc_id, count(*) FILTER (len > 10) AS runs, sum(CASE WHEN len > 10 THEN 1 ELSE len END) AS clean FROM n GROUP BY doc_id) "
    "SELECT doc_id, coalesce(runs, 0) AS runs, CAST(coalesce(clean, 0) AS BIGINT) AS clean_chars FROM documents LEFT JOIN s USING (doc_id)",
    "qc_verdicts": "SELECT doc_id, doc_id % 37 AS truncations, doc_id % 6 AS pages, CASE WHEN doc_id % 37 > 20 OR doc_id % 37 > 5 * greatest(doc_id % 6, 1) THEN 'reject_loop' ELSE 'accept' END AS verdict FROM documents",
    "stub_gate": r"SELECT doc_id, doc_id % 3 <= 1 AND (length(regexp_replace(text, '\s+', '', 'g')) < 500 OR (doc_id % 40) / 10.0 < 1.0) AS stub FROM documents",
    "page_offsets": _with(
        "markdown",
        f"SELECT conv_id, page, start AS char_start, start + strlen(p) AS char_end FROM (SELECT conv_id, page, p, CAST(coalesce(sum(strlen(p) + 7) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT conv_id, unnest(string_split(markdown, {SEP})) AS p, generate_subscripts(string_split(markdown, {SEP}), 1) AS page FROM markdown))",
    ),
    "page_slice": _with("markdown", f"SELECT conv_id, string_split(markdown, {SEP})[2] AS page_text FROM markdown WHERE len(string_split(markdown, {SEP})) >= 2"),
    "year_extract": r"SELECT doc_id, y AS year FROM (SELECT doc_id, regexp_extract(array_to_string(string_split(text, chr(10))[1:50], chr(10)), '\b(?:19|20)\d{2}\b') AS y FROM documents) WHERE y <> ''",
    "sanitize_year": "SELECT doc_id, CASE WHEN y BETWEEN 1900 AND 2025 THEN y END AS year FROM (SELECT doc_id, TRY_CAST(substr(CAST((doc_id * 7) % 2300 AS VARCHAR) || '-01-01', 1, 4) AS BIGINT) AS y FROM documents)",
    "orphan_files": _with("sources catalog", "SELECT stem, source_ext FROM sources WHERE stem NOT IN (SELECT stem FROM catalog)"),
    "converted_no_markdown": _with("md catalog", "SELECT stem FROM catalog WHERE has_conversion AND NOT failed AND stem NOT IN (SELECT stem FROM md)"),
    "phantom_rows": _with("sources md catalog", "SELECT stem FROM catalog WHERE stem NOT IN (SELECT stem FROM md) AND stem NOT IN (SELECT stem FROM sources)"),
    "flag_drift": _with(
        "sources md catalog",
        "SELECT * FROM (SELECT stem, NOT has_conversion AND stem IN (SELECT stem FROM md) AS conversion_missing, downloaded_at IS NULL AND stem IN (SELECT stem FROM sources) AS download_missing FROM catalog WHERE NOT failed) WHERE conversion_missing OR download_missing",
    ),
    "path_drift": _with("md catalog", "SELECT stem, coalesce(markdown_path, '') AS stale_path, key AS resolved_path FROM catalog JOIN md USING (stem) WHERE coalesce(markdown_path, '') <> key"),
    "stuck_convert": _with("sources catalog", "SELECT stem, source_ext FROM catalog JOIN sources USING (stem) WHERE NOT has_conversion"),
    "repair_counts": _with("sources md catalog", "").rstrip()
    + ", "
    + _REPAIR
    + " SELECT * FROM (SELECT 'disk_no_catalog' AS direction, count(*) AS n FROM orphan UNION ALL SELECT 'catalog_no_markdown', count(*) FROM nomd UNION ALL SELECT 'catalog_no_source', count(*) FROM phantom UNION ALL SELECT 'flag_drift', count(*) FROM flags UNION ALL SELECT 'path_drift', count(*) FROM paths UNION ALL SELECT 'stuck_convert', count(*) FROM stuck) WHERE n > 0",
    "reconcile_class": _with("md indexed catalog", _CLASS),
    "reconcile_counts": _with("md indexed catalog", f"SELECT class, count(*) AS n FROM ({_CLASS}) GROUP BY class"),
    "index_orphans": _with("md indexed", "SELECT DISTINCT doc_id AS stem FROM indexed WHERE doc_id NOT IN (SELECT stem FROM md)"),
    "url_twins": "WITH s AS (SELECT 'a b+' || doc_id AS stem FROM documents UNION ALL SELECT 'a%20b+' || doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'c%20' || doc_id FROM documents WHERE doc_id % 5 = 0) SELECT stem, replace(stem, '%20', ' ') AS twin FROM s WHERE contains(stem, '%20') AND replace(stem, '%20', ' ') IN (SELECT stem FROM s)",
    "catalog_listing": _with("catalog", "SELECT stem, downloaded_at IS NOT NULL AS downloaded, has_conversion AS converted, failed AS conversion_failed, has_embedding AND chunks > 0 AS embedded, has_skip AS embed_skipped, has_repair AS repaired FROM catalog"),
    "catalog_page": _with(
        "catalog",
        "SELECT stem, downloaded_at IS NOT NULL AS downloaded, has_conversion AS converted, failed AS conversion_failed, true AS embedded, has_skip AS embed_skipped, has_repair AS repaired FROM catalog WHERE has_embedding AND chunks > 0 ORDER BY stem LIMIT 50 OFFSET 50",
    ),
    "markdown_listing": _with("md catalog", "SELECT md.stem, coalesce(CASE WHEN has_conversion THEN i % 5 + 1 END, 0) AS total_pages FROM md LEFT JOIN catalog USING (stem)"),
    "embed_backfill": _with("catalog", "SELECT stem FROM catalog WHERE has_conversion AND NOT failed AND NOT has_embedding AND NOT has_skip"),
    "title_backfill": _with("catalog", "SELECT stem, doi FROM catalog WHERE doi IS NOT NULL AND title IS NULL"),
    "catalog_backfill": _with("md catalog", "SELECT stem, key, 'markdown/' || substr(stem, 1, 2) || '/' || stem || '.md' AS sharded_key FROM md WHERE stem NOT IN (SELECT stem FROM catalog)"),
    "history_events": _with("history", "SELECT * FROM history"),
    "history_recent": _with("history", "SELECT * FROM history ORDER BY history.at DESC, stem, activity LIMIT 30"),
    "pipeline_counts": _with(
        "files catalog",
        "SELECT *, greatest(greatest(greatest(documents - markdown, 0) - failed, 0), 0) AS drift, round(coalesce(least(failed / nullif(documents, 0), 1), 0), 6) AS failed_share, round(coalesce(least(markdown / nullif(documents - failed, 0), 1), 0), 6) AS markdown_share, round(coalesce(least(embedded / nullif(markdown, 0), 1), 0), 6) AS embedded_share "
        "FROM (SELECT count(*) FILTER (ext = 'pdf') AS pdf, count(*) FILTER (ext = 'html') AS html, count(*) FILTER (ext = 'md') AS markdown, count(*) FILTER (ext IN ('pdf', 'html')) AS documents FROM files), (SELECT count(*) FILTER (failed) AS failed, count(*) FILTER (has_embedding AND chunks > 0) AS embedded, count(*) AS catalog FROM catalog)",
    ),
    "html_sniff": r"SELECT page_id, contains(lower(substr(html, 1, 512)), '<html') OR contains(lower(substr(html, 1, 512)), '<!doctype html') AS is_html, "
    + "(login AND (strlen(html) < 100000 OR NOT article)) OR (visible < 500 AND NOT article) OR waiting OR (other AND NOT article) AS is_paywall FROM (SELECT page_id, html, "
    + "(" + " OR ".join(f"contains(lower(html), '{p}')" for p in ("sign in", "log in", "access denied", "403 forbidden", "subscription required", "purchase this article", "institutional access")) + ") AS login, "
    + "contains(lower(html), '<article') OR (contains(lower(html), 'abstract') AND contains(lower(html), 'references')) AS article, "
    + r"strlen(regexp_replace(regexp_replace(lower(html), '<[^>]*(>|$)|>', '', 'g'), '^\s+|\s+$', '', 'g')) AS visible, "
    + "(" + " OR ".join(f"contains(lower(html), '{p}')" for p in ("preparing to download", "hhs vulnerability disclosure", "please wait while the document loads")) + ") AS waiting, "
    + "(" + " OR ".join(f"contains(lower(html), '{p}')" for p in ("impact factor", "citescore", "aims and scope", "clinical trials", "browse collections", "search results", "cookie policy")) + ") AS other FROM pages)",
    "junk_html": _with("plain catalog", "").rstrip()
    + ", "
    + _QUALITY
    + "SELECT 'd' || d.doc_id AS stem FROM documents d JOIN r USING (doc_id) JOIN catalog c ON c.i = d.doc_id WHERE c.has_conversion AND d.doc_id % 4 = 0 AND d.doc_id % 5 + 1 <= 1 AND (reject_reason IS NOT NULL OR contains(lower(text), 'preparing to download') OR contains(lower(text), 'please wait while the document loads') OR (contains(lower(text), 'hhs vulnerability disclosure') AND strlen(text) < 2000))",
    "iou_pairs": _with(
        "boxes",
        f"SELECT doc, a_id, b_id, round(iou, 6) AS iou FROM (SELECT a.doc, a.unique_id AS a_id, b.unique_id AS b_id, coalesce({_IOU_INTER} / nullif({_AREA.format('a')} + {_AREA.format('b')} - {_IOU_INTER}, 0), 0) AS iou FROM boxes a JOIN boxes b ON a.doc = b.doc AND a.unique_id < b.unique_id) WHERE iou > 0.1",
    ),
    "covered_references": _with(
        "boxes",
        f"SELECT doc, unique_id FROM boxes WHERE (doc, unique_id) NOT IN (SELECT (a.doc, a.unique_id) FROM boxes a JOIN boxes b ON a.doc = b.doc WHERE a.class_name = 'reference' AND b.class_name = 'reference_content' AND {_AREA.format('b')} > 0 AND {_IOU_INTER} / ({_AREA.format('b')}) > 0.80 GROUP BY a.doc, a.unique_id HAVING count(*) >= 2)",
    ),
    "region_routes": _with("boxes", f"SELECT {_ROUTE} AS route, count(*) AS n FROM boxes GROUP BY 1"),
    "text_only_pages": _with("boxes", f"SELECT doc, NOT bool_or({_ROUTE} IN ('table', 'formula')) AS full_page FROM boxes GROUP BY doc"),
    "page_assembly": _with(
        "boxes",
        "SELECT doc, string_agg(md, chr(10) || chr(10) ORDER BY unique_id, md) AS markdown FROM (SELECT doc, unique_id, CASE class_name WHEN 'image' THEN '![Figure]' WHEN 'display_formula' THEN '$$' || chr(10) || 'display_formula ' || unique_id || chr(10) || '$$' ELSE class_name || ' ' || unique_id END AS md FROM boxes WHERE class_name <> 'header') GROUP BY doc",
    ),
    "clamped_boxes": _with("boxes", "SELECT doc, unique_id, least(greatest(x1, 0), 60.0) AS x1, least(greatest(y1, 0), 50.0) AS y1, least(greatest(x2, 0), 60.0) AS x2, least(greatest(y2, 0), 50.0) AS y2 FROM boxes WHERE confidence >= 0.05"),
    "eval_means": "WITH p AS (SELECT (doc_id % 10) / 10.0 AS ned, (doc_id % 7) / 7.0 AS bleu, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 100) * 1.0::DOUBLE END AS text, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 90) * 1.0::DOUBLE END AS tab, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 80) * 1.0::DOUBLE END AS formula FROM documents), "
    "c AS (SELECT *, coalesce(list_avg(list_filter([CASE WHEN text > 50 OR (tab IS NULL AND formula IS NULL) THEN text END, tab, formula], lambda x: x IS NOT NULL)), 0) AS composite FROM p) "
    "SELECT count(*) AS n_pages, round(avg(ned), 6) AS mean_ned, round(avg(bleu), 6) AS mean_bleu, round(avg(composite), 6) AS mean_composite, round(avg(text), 6) AS mean_text, round(avg(tab), 6) AS mean_table, round(avg(formula), 6) AS mean_formula, round((avg(text) + avg(tab) + avg(formula)) / 3, 6) AS overall FROM c",
    "event_latest": "SELECT user_id, max(event_id) AS last_event, count(*) AS n_events FROM events GROUP BY user_id",
    "heartbeat_stale": "SELECT event_type AS service_type, CAST(user_id AS VARCHAR) AS url, max(ts) > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 86400 SECOND AS healthy FROM events GROUP BY 1, 2",
    "event_dedup": "SELECT event_type || '/' || user_id AS key, min(event_id) AS event_id FROM events GROUP BY 1",
    "event_payloads": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY event_type",
    "resolved_downloads": _with(
        "papers",
        "SELECT id, CASE WHEN doc_id % 7 = 0 THEN 'pmc/' || id WHEN len(urls) > 0 THEN urls[1] END AS url, CASE WHEN doc_id % 7 = 0 THEN 'pmc' WHEN len(urls) > 0 THEN 'provider' ELSE 'not_found' END AS resolver FROM papers",
    ),
    "stamped_catalog": _with(
        "catalog",
        "SELECT stem, CASE WHEN i % 10 <> 0 AND i % 9 > 0 THEN i % 9 WHEN has_embedding THEN chunks END AS chunks, "
        "CASE WHEN i % 10 = 0 OR i % 9 = 0 THEN 'zero_chunks' WHEN has_skip THEN skip_reason END AS skip_reason FROM catalog",
    ),
}
