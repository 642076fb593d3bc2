"""DuckDB SQL of more_queries.py, and of queries on whole texts in ASCII, whose characters DuckDB counts as bytes."""

from __future__ import annotations

from scholia.plans.oracle import _CLASS, _COSINE, _Q0, _QUALITY, _REPAIR, _with

_STEM = "'d' || doc_id"
_PAPER = "'Title ' || doc_id AS title"
_PAIRS = "pairs AS (SELECT b.item_id, b.text, n.text AS hyp FROM benchmark b JOIN benchmark n ON n.item_id = b.item_id + 1)"
_NED = r"""ned AS (SELECT item_id, CASE WHEN greatest(length(a), length(b)) = 0 THEN 0 ELSE levenshtein(a, b) * 1.0::DOUBLE / greatest(length(a), length(b)) END AS ned FROM (
    SELECT item_id, regexp_replace(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '[^A-Za-z0-9]', '', 'g') AS a, regexp_replace(regexp_replace(hyp, '[^\x00-\x7F]', 'x', 'g'), '[^A-Za-z0-9]', '', 'g') AS b FROM pairs))"""
_KINDS = "['pdf', 'HTML', 'epub', 'part', 'txt', 'mobi'][doc_id % 6 + 1]"


def _precision(n: int) -> str:
    """Counts of clipped and of all n-grams."""
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    grams = lambda side: f"(SELECT item_id, g, count(*) AS c FROM (SELECT item_id, unnest(list_transform(range(1, len({side}) - {n - 2}), lambda i: {gram.replace('w[', side + '[')})) AS g FROM w WHERE len({side}) >= {n}) GROUP BY 1, 2)"
    return (
        f"p{n} AS (SELECT w.item_id, coalesce(sum(m.c), 0) * 1.0::DOUBLE / nullif(greatest(any_value(len(h)) - {n - 1}, 0), 0) AS p FROM w LEFT JOIN "
        f"(SELECT a.item_id, least(a.c, b.c) AS c FROM {grams('h')} a JOIN {grams('r')} b USING (item_id, g)) m USING (item_id) GROUP BY w.item_id)"
    )


MORE: dict[str, str] = {
    "metadata_join": _with(
        "catalog",
        r"SELECT 'd' || doc_id AS doc_id, title, doi, CASE WHEN y BETWEEN 1900 AND 2025 THEN y END AS year, 'papers/' || substr('d' || doc_id, 1, 2) || '/d' || doc_id || '.pdf' AS pdf_path "
        r"FROM (SELECT doc_id, TRY_CAST(regexp_extract(array_to_string(string_split(text, chr(10))[1:50], chr(10)), '\b(?:19|20)\d{2}\b') AS BIGINT) AS y FROM documents) d JOIN catalog ON catalog.i = d.doc_id",
    ),
    "source_ranks": _with("papers", "SELECT id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1009, id) - 1 AS INTEGER) AS rank FROM papers"),
    "source_union": _with("papers", "SELECT source, source <> 'core' AS ok, CASE WHEN source <> 'core' THEN count(*) END AS n FROM papers GROUP BY source"),
    "doi_lookup": _with("merged", "SELECT id, title, source, cited_by_count, round(rrf, 6) AS rrf FROM merged WHERE doi_key = '10.1/ab10'"),
    "provider_openalex": f"SELECT 'W' || doc_id AS id, {_PAPER}, 'alpha w' || doc_id || ' alpha' AS abstract_text, '2020-05-17' AS publication_date, '10.1/' || doc_id AS doi, 'best p' || doc_id AS urls, n_chars AS cited_by_count FROM documents",
    "provider_semantic_scholar": f"SELECT CAST(doc_id AS VARCHAR) AS id, {_PAPER}, text AS abstract_text, (1990 + doc_id % 30) || '-01-01' AS publication_date, CASE WHEN doc_id % 2 = 0 THEN '10.1/' ELSE '10.48550/arXiv.' END || doc_id AS doi, '' AS urls, n_chars AS cited_by_count FROM documents",
    "provider_europe_pmc": f"SELECT CAST(doc_id AS VARCHAR) AS id, {_PAPER}, NULL AS abstract_text, '2019-01-02' AS publication_date, '10.1/' || doc_id AS doi, 'p' || doc_id AS urls, n_chars AS cited_by_count, 'A B;C D' AS authors FROM documents",
    "provider_crossref": f"SELECT '10.1/' || doc_id AS id, {_PAPER}, NULL AS abstract_text, (2000 + doc_id % 20) || '-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-01' AS publication_date, '10.1/' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN 'p' || doc_id ELSE '' END AS urls, n_chars AS cited_by_count FROM documents",
    "provider_core": f"SELECT CAST(doc_id AS VARCHAR) AS id, {_PAPER}, NULL AS abstract_text, CASE WHEN doc_id % 3 > 0 THEN '2010-01-01' END AS publication_date, '10.1/' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'u' END AS urls, CAST(NULL AS BIGINT) AS cited_by_count FROM documents",
    "provider_arxiv": "SELECT '2001.' || doc_id AS id, 'Title of ' || doc_id AS title, 's' AS abstract_text, '2020-01-05' AS publication_date, '10.48550/arXiv.2001.' || doc_id AS doi FROM documents",
    "repair_samples": _with("sources md catalog", "").rstrip()
    + ", "
    + _REPAIR
    + " SELECT direction, stem, CAST(n AS INTEGER) AS n FROM (SELECT direction, stem, row_number() OVER (PARTITION BY direction ORDER BY stem) AS n FROM (SELECT 'disk_no_catalog' AS direction, stem FROM orphan UNION ALL SELECT 'catalog_no_markdown', stem FROM nomd UNION ALL SELECT 'catalog_no_source', stem FROM phantom UNION ALL SELECT 'flag_drift', stem FROM flags UNION ALL SELECT 'path_drift', stem FROM paths UNION ALL SELECT 'stuck_convert', stem FROM stuck)) WHERE n <= 10",
    "catalog_delete": f"SELECT {_STEM} AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "reconcile_actions": _with("md indexed catalog", f"SELECT stem, CASE class WHEN 'stamp_missing' THEN 'fix_stamp' ELSE 'reembed' END AS action FROM ({_CLASS}) WHERE class <> 'ok'"),
    "catalog_without_twins": "SELECT 'a b' || doc_id AS stem FROM documents UNION ALL SELECT 'c%20' || doc_id FROM documents WHERE doc_id % 5 = 0",
    "shard_moves": _with("objects", "SELECT key, 'markdown/' || substr(split_part(key, '/', 2), 1, 2) || '/' || split_part(key, '/', 2) AS target FROM objects WHERE starts_with(key, 'markdown/') AND NOT contains(substr(key, 10), '/')"),
    "conversion_stamps": _with("catalog", "SELECT stem, CASE WHEN i % 4 = 0 THEN markdown_path ELSE 'm/' || stem END AS markdown_path, i % 4 AS pages, i % 4 = 0 AS failed, CASE WHEN i % 4 = 0 THEN 'stub' END AS reason FROM catalog"),
    "points_purge": "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (1, 7)",
    "vector_topk_topic": f"SELECT vec_id, label, CAST(2000 + vec_id % 20 AS INTEGER) AS year, {_COSINE} AS score FROM embeddings e, {_Q0} WHERE label = 3 AND vec_id % 20 >= 5 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.v) DESC, vec_id LIMIT 5",
    "inbox_outcomes": f"""WITH k AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '._' ELSE '' END || 'Ab' || doc_id AS stem, {_KINDS} AS ext FROM documents),
        o AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'papers/x/' ELSE 'papers/manually_downloaded/' END || stem || '.' || ext AS key,
          CASE WHEN doc_id % 7 = 0 THEN 'ignored_non_inbox' WHEN doc_id % 11 = 0 OR ext NOT IN ('pdf', 'HTML', 'epub') THEN 'ignored_unsupported' WHEN doc_id % 9 < 5 THEN 'still_writing' ELSE 'commit' END AS outcome FROM k)
        SELECT key, outcome, CASE WHEN outcome = 'commit' THEN 'papers/' || substr(stem, 1, 2) || '/' || stem || '.' || CASE WHEN ext = 'epub' THEN 'html' ELSE lower(ext) END END AS target_key FROM o""",
    "processable_files": _with("objects", "SELECT key FROM objects WHERE regexp_matches(key, '[.](pdf|html|htm|epub)$') AND NOT contains(key, '/._')"),
    "reason_texts": _with("plain", "").rstrip()
    + ", "
    + _QUALITY
    + "SELECT doc_id, CASE reject_reason WHEN 'too_short' THEN printf('too short (%d non-whitespace chars)', non_ws) WHEN 'dominant_char' THEN printf('one character is %.0f%% of the text', round(char_share * 100)) WHEN 'low_diversity' THEN printf('only %.0f%% of the words differ', round(diversity * 100)) ELSE printf('one 4-gram is %.0f%% of the text', round(gram * 100)) END AS reason FROM r WHERE reject_reason IS NOT NULL",
    "identifier_kinds": "SELECT doc_id, doc_id % 4 IN (0, 2) AS is_doi, doc_id % 4 = 1 AS is_arxiv, CASE WHEN doc_id % 4 = 2 THEN CAST(doc_id AS VARCHAR) END AS arxiv_id, "
    "CASE doc_id % 4 WHEN 0 THEN '10.1_' WHEN 1 THEN '2001.' WHEN 2 THEN '10.48550_ArXiv.' ELSE 'a_b_' END || doc_id AS file_name FROM documents",
    "small_columns": "SELECT doc_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age, "
    "CASE WHEN n >= 1000000 THEN printf('%.1f GB', round(n / 1e6, 1)) WHEN n >= 1000 THEN printf('%.1f MB', round(n / 1e3, 1)) WHEN n >= 1 THEN printf('%.1f KB', round(n * 1.0::DOUBLE, 1)) ELSE printf('%.0f B', n * 1000.0::DOUBLE) END AS size, "
    "CAST(floor(n * f) AS INTEGER) AS width, CAST(floor(500 * f) AS INTEGER) AS height, n * 2.0::DOUBLE AS pixels, doc_id || '.5 and 7.' || doc_id AS digits "
    "FROM (SELECT doc_id, n_chars AS n, n_chars * 37 AS s, least(1.0::DOUBLE, 1000.0::DOUBLE / greatest(n_chars, 500)) AS f FROM documents)",
    "markdown_titles": "SELECT DISTINCT conv_id, 'Conversation ' || conv_id AS title FROM conversations",
    "tag_free_pages": "SELECT page_id, regexp_replace(html, '<[^>]*(>|$)|>', '', 'g') AS plain FROM pages",
    "table_markup": """SELECT l_orderkey, l_linenumber, '<table><thead class="x"><tr><td><b>' || l_partkey || '</b></td><td colspan="2">' || l_returnflag || '</td><td></td></tr></thead></table>' AS html,
        '<table><thead><tr><td>' || l_partkey || '</td><td colspan="2">' || l_returnflag || '</td><td></td></tr></thead></table>' AS canonical FROM lineitem""",
    "numbered_boxes": _with("boxes", "SELECT doc, x1 AS read_order, CAST(row_number() OVER (PARTITION BY doc ORDER BY x1, unique_id) - 1 AS INTEGER) AS unique_id FROM boxes"),
    "text_scores": f"WITH {_PAIRS}, {_NED} SELECT item_id, round((1 - ned) * 100, 6) AS score FROM ned",
    "eval_report": """WITH p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, (doc_id % 10) / 10.0 AS ned, doc_id % 3 * 10.0 AS composite, CASE WHEN doc_id % 4 = 1 THEN doc_id % 90 END AS tab FROM documents)
        SELECT coalesce(dataset, 'all') AS dataset, count(*) AS n_pages, round(avg(ned), 6) AS mean_ned, 0.5 AS mean_bleu, round(avg(composite), 6) AS mean_composite, 1.0 AS mean_text, round(coalesce(avg(tab), 0), 6) AS mean_table, 0.0 AS mean_formula FROM p GROUP BY ROLLUP (dataset)""",
    "tab_lines": _with("papers", "SELECT concat_ws(chr(9), coalesce(title, ''), array_to_string(list_transform(range(1, n_authors + 1), lambda k: 'author ' || k), ', '), coalesce(CAST(publication_date AS VARCHAR), ''), coalesce(doi, '-')) AS value FROM papers"),
    "json_lines": _with("papers", "SELECT CAST(json_object('id', id, 'doi', doi, 'cited_by_count', cited_by_count) AS VARCHAR) AS value FROM papers"),
    # queries of queries.py whose texts are in ASCII or whose tokens need no character distance
    "ned_pairs": f"WITH {_PAIRS}, {_NED} SELECT item_id, round(ned, 6) AS ned FROM ned",
    "bleu_pairs": rf"WITH {_PAIRS}, w AS (SELECT item_id, regexp_extract_all(lower(text), '\S+') AS r, regexp_extract_all(lower(text || ' ' || hyp), '\S+') AS h FROM pairs), "
    + ", ".join(_precision(n) for n in range(1, 5))
    + " SELECT w.item_id, round(CASE WHEN len(r) = 0 OR len(h) = 0 OR coalesce(p1.p * p2.p * p3.p * p4.p, 0) = 0 THEN 0 ELSE exp((ln(p1.p) + ln(p2.p) + ln(p3.p) + ln(p4.p)) / 4) * CASE WHEN len(h) >= len(r) THEN 1 ELSE exp(1 - len(r) * 1.0::DOUBLE / len(h)) END END, 6) AS bleu "
    "FROM w JOIN p1 USING (item_id) JOIN p2 USING (item_id) JOIN p3 USING (item_id) JOIN p4 USING (item_id)",
    "cdm_pairs": rf"""WITH {_PAIRS}, t AS (SELECT item_id, regexp_extract_all(lower(replace('{{' || text || '}}', ' ', '')), '[0-9]+|\S') AS r, regexp_extract_all(lower(replace('{{' || hyp || '}}', ' ', '')), '[0-9]+|\S') AS h FROM pairs),
        c AS (SELECT item_id, x, count(*) FILTER (side = 'r') AS a, count(*) FILTER (side = 'h') AS b FROM (SELECT item_id, 'r' AS side, unnest(r) AS x FROM t UNION ALL SELECT item_id, 'h', unnest(h) FROM t) GROUP BY item_id, x)
        SELECT item_id, round(least(200.0::DOUBLE * sum(least(a, b)) / sum(a + b), 100), 6) AS cdm FROM c GROUP BY item_id""",
    "fuzzy_title_pairs": _with("papers", "").rstrip()
    + r""", rows AS (SELECT *, lower(replace(doi, 'https://doi.org/', '')) AS doi_key, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(regexp_replace(title, '[^\x00-\x7F]', 'x', 'g')), '[^\p{L}\p{N}\s]', '', 'g'), '\S+'), lambda w: w NOT IN ('the', 'a', 'an')), ' ') AS tk FROM papers),
        placed AS (SELECT *, row_number() OVER (ORDER BY weight DESC, rank, id) AS pos FROM rows),
        lead AS (SELECT 'd:' || doi_key AS key, 0 AS kind, arg_min(tk, pos) AS tk, min(pos) AS pos FROM placed WHERE doi_key IS NOT NULL GROUP BY doi_key UNION ALL SELECT 't:' || tk, 1, tk, min(pos) FROM placed WHERE doi_key IS NULL GROUP BY tk),
        near AS (SELECT a.key AS a, b.key AS b, CASE WHEN greatest(length(a.tk), length(b.tk)) = 0 THEN 1 ELSE 1 - levenshtein(a.tk, b.tk) * 1.0::DOUBLE / greatest(length(a.tk), length(b.tk)) END AS s
          FROM lead a JOIN lead b ON b.kind = 1 AND (a.kind, a.pos) < (b.kind, b.pos) AND least(length(a.tk), length(b.tk)) >= 0.85 * greatest(length(a.tk), length(b.tk)) - 1e-9)
        SELECT a, b, round(s, 6) AS similarity FROM near WHERE s >= 0.85 AND NOT (a = b)""",
}
