"""The registered queries over the derived views; oracle.py has their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.functions.dates import DateFilter, year_condition
from scholia.functions.html import html_to_markdown
from scholia.functions.repetition import char_runs, cleaned, without_char_runs
from scholia.operators import catalog as C
from scholia.operators import evaluate as E
from scholia.operators import layout as L
from scholia.operators import quality as Q
from scholia.operators import status as S
from scholia.operators import vectors as V
from scholia.operators.chunk import chunks
from scholia.operators.dedup import dedup, dedup_stats, doi_groups, leaders, similar_titles
from scholia.operators.merge import merge_groups, ranked
from scholia.plans import views
from scholia.plans.indexing import index_documents
from scholia.plans.metasearch import enough_citations, good_title, metasearch
from scholia.plans.views import table
from scholia.plans.written import written
from scholia.streaming import ingest as I

QUERY = "the and of"
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _r(c, name):
    return F.round(c, 6).alias(name)


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


# vectors


@query
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    return V.top_k(points, _first_vector(spark, sf_dir), 10, "vec_id", where=F.col("label") < 5).select("vec_id", "label", _r(F.col("score"), "score"))


@query
def vector_knn_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    return V.knn_by_group(points, _first_vector(spark, sf_dir), 3, "label", "vec_id").select("label", "rank", "vec_id", _r(F.col("score"), "score"))


@query
def facet_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.doc_facet(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query
def distinct_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.doc_count(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query
def vector_delete_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return V.delete_docs(table(spark, sf_dir, "embeddings"), gone, "vec_id").select("vec_id", "label")


# papers


@query
def doi_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doi_groups(views.papers(spark, sf_dir)).where("doi_key IS NOT NULL")
    return rows.groupBy("doi_key").agg(F.count(F.lit(1)).alias("n_papers"), F.min_by("id", "pos").alias("first_id"))


@query
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merge_groups(doi_groups(views.papers(spark, sf_dir)).where("doi_key IS NOT NULL"), "doi_key")
    return m.select(
        "doi_key", "id", "title", F.size("authors").cast("long").alias("n_authors"), F.octet_length("abstract_text").cast("long").alias("abstract_bytes"), F.col("publication_date").cast("string").alias("publication_date"),
        "doi", F.array_join("download_urls", " ").alias("urls"), "cited_by_count", "source", _r(F.col("rrf"), "rrf"),
    )


@query
def blended_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merge_groups(doi_groups(views.papers(spark, sf_dir)).where("doi_key IS NOT NULL"), "doi_key")
    return ranked(m, QUERY).select("doi_key", _r(F.col("relevance"), "relevance"), _r(F.col("score"), "score"))


@query
def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.papers(spark, sf_dir).select("id", _r(T.relevance(QUERY, "title", "abstract_text", "doi", "publication_date"), "relevance"))


@query
def title_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.papers(spark, sf_dir).where(good_title(F.col("title"))).select("id", "title")


@query
def min_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.papers(spark, sf_dir).where(enough_citations(F.col("cited_by_count"), 500)).select("id", "cited_by_count")


@query
def normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.papers(spark, sf_dir).groupBy(T.normalized_title("title").alias("title_key")).agg(F.count(F.lit(1)).alias("n"))


@query
def date_filter_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.papers(spark, sf_dir).where(DateFilter.parse(">2016-06 <=2019").condition("publication_date")).select("id", F.col("publication_date").cast("string").alias("publication_date"))


@query
def date_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").where(DateFilter.parse(">=1994 <1995-07-01").condition(day)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def year_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return rows.where(year_condition(">=1996", "y")).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query
def downloadable_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.plans.metasearch import downloadable

    return downloadable(views.papers(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query
def fuzzy_title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in ASCII, as the SQL counts bytes."""
    papers = views.papers(spark, sf_dir).withColumn("title", F.regexp_replace("title", r"[^\x00-\x7F]", "x"))
    return similar_titles(written(leaders(papers))).select("a", "b", _r(F.col("sim"), "similarity"))


@query
def fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(views.papers(spark, sf_dir), written).select("id", "group_key", "match_type")


@query
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_stats(dedup(views.papers(spark, sf_dir), written))


@query
def metasearch_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metasearch(views.papers(spark, sf_dir), QUERY, 20, ">=2015", 10).select("id", "title", "source", _r(F.col("relevance"), "relevance"), _r(F.col("score"), "score"))


# texts


@query
def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_quality(views.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", F.col("non_ws").cast("long").alias("non_ws"), _r(F.col("char_share"), "char_share"), _r(F.col("diversity"), "diversity"))


@query
def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_quality(views.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "reject_reason")


@query
def quality_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality_tally(Q.with_quality(views.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


@query
def repetition_char_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", char_runs(F.col("text")).cast("long").alias("runs"), F.length(without_char_runs(F.col("text"))).cast("long").alias("clean_chars"))


@query
def repetition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.explode(F.array(cleaned(F.col("text")))).alias("clean")
    rows = views.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", state)
    return rows.select("doc_id", F.col("clean.sites").cast("long").alias("sites"), F.length("clean.text").cast("long").alias("clean_chars"))


@query
def qc_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 37).alias("truncations"), (F.col("doc_id") % 6).alias("pages"))
    return d.withColumn("verdict", Q.qc_verdict(F.col("truncations"), F.col("pages")))


@query
def stub_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("pages", F.col("doc_id") % 3).withColumn("seconds", (F.col("doc_id") % 40) / 10.0)
    return d.select("doc_id", Q.is_stub(F.col("pages"), F.col("text"), F.col("seconds")).alias("stub"))


@query
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.markdown(spark, sf_dir).select("conv_id", F.explode(T.page_offsets("markdown")).alias("p"))
    return rows.select("conv_id", F.col("p.page").cast("long").alias("page"), F.col("p.char_start").cast("long").alias("char_start"), F.col("p.char_end").cast("long").alias("char_end"))


@query
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.markdown(spark, sf_dir).select("conv_id", T.page("markdown", 2).alias("page_text")).where("page_text IS NOT NULL")


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(views.spread(table(spark, sf_dir, "documents"))).drop("text", "raw_text")


@query
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of paged markdown against the page table: each lies in the page of its first byte."""
    md = views.markdown(spark, sf_dir)
    own = chunks(md.withColumnRenamed("conv_id", "doc_id"), text_col="markdown").select(F.col("doc_id").alias("conv_id"), "chunk_index", "char_start", "page")
    pages = md.select("conv_id", T.page_offsets("markdown").alias("pages"))
    hit = F.get(F.filter("pages", lambda p: (F.col("char_start") >= p["char_start"]) & (F.col("char_start") < p["char_end"])), F.lit(0))["page"]
    return own.join(pages, "conv_id").select("conv_id", "chunk_index", "page", hit.alias("resolved_page"))


@query
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_year("text").alias("year")).where("year IS NOT NULL")


@query
def sanitize_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(((F.col("doc_id") * 7) % 2300).cast("string"), F.lit("-01-01")).alias("day"))
    return d.select("doc_id", T.sane_year("day", 2024).alias("year"))


@query
def index_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_documents(views.spread(table(spark, sf_dir, "documents"))).select("point_id", "doc_id", "chunk_index", "total_chunks", "page", "line_start", "char_start", "char_end")


# catalog


def _tables(spark: SparkSession, sf_dir: str):
    listing = views.objects(spark, sf_dir)
    return views.catalog(spark, sf_dir), views.of_prefix(listing, "papers"), views.of_prefix(listing, "markdown")


@query
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, papers, _ = _tables(spark, sf_dir)
    return C.orphan_files(cat, papers)


@query
def converted_no_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, _, md = _tables(spark, sf_dir)
    return C.converted_without_markdown(cat, md)


@query
def phantom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.phantom_rows(*_tables(spark, sf_dir))


@query
def flag_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.flag_drift(*_tables(spark, sf_dir))


@query
def path_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, _, md = _tables(spark, sf_dir)
    return C.path_drift(cat, md)


@query
def stuck_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, papers, _ = _tables(spark, sf_dir)
    return C.stuck_convert(cat, papers)


@query
def repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repair_plan(*_tables(spark, sf_dir)).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query
def reconcile_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, _, md = _tables(spark, sf_dir)
    return C.reconcile(md, views.indexed(spark, sf_dir), cat)


@query
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_class(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query
def index_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.index_orphans(views.indexed(spark, sf_dir), _tables(spark, sf_dir)[2])


@query
def url_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    stems = F.array(F.concat(F.lit("a b+"), n), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a%20b+"), n)), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("c%20"), n)))
    return C.encoded_twins(table(spark, sf_dir, "documents").select(F.explode(F.array_compact(stems)).alias("stem")))


@query
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.listing(views.catalog(spark, sf_dir))


@query
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of embedded rows."""
    return C.listing(views.catalog(spark, sf_dir), True).orderBy("stem").offset(50).limit(50)


@query
def markdown_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, _, md = _tables(spark, sf_dir)
    return C.markdown_of(md).join(cat.select("stem", F.col("conversion.total_pages").alias("pages")), "stem", "left").select("stem", F.coalesce("pages", F.lit(0)).alias("total_pages"))


@query
def embed_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.embed_candidates(views.catalog(spark, sf_dir))


@query
def title_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.title_candidates(views.catalog(spark, sf_dir))


@query
def catalog_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, _, md = _tables(spark, sf_dir)
    return C.catalog_backfill(cat, md)


@query
def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.history(views.catalog(spark, sf_dir))


@query
def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.recent(views.catalog(spark, sf_dir))


@query
def pipeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.snapshot(views.catalog(spark, sf_dir), views.objects(spark, sf_dir))
    return s.select("pdf", "html", "markdown", "documents", "failed", "embedded", "catalog", "drift", *[_r(F.col(c), c) for c in ("failed_share", "markdown_share", "embedded_share")])


# pages and regions


@query
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_to_markdown("html").alias("markdown"))


@query
def html_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", Q.is_html(F.col("html")).alias("is_html"), Q.is_paywall(F.col("html")).alias("is_paywall"))


@query
def junk_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what the catalog says of a document is asked before its text is measured
    cat = views.catalog(spark, sf_dir).select("stem", "conversion").where(Q.is_local_page(F.col("conversion.server"), F.col("conversion.total_pages")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("stem", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    rows = Q.with_quality(docs.join(cat, "stem"))
    return rows.where(Q.is_junk_html(F.col("conversion.server"), F.col("conversion.total_pages"), F.col("text"), F.col("reject_reason"))).select("stem")


@query
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.overlapping(views.boxes(spark, sf_dir), 0.1).select("doc", "a_id", "b_id", _r(F.col("iou"), "iou"))


@query
def covered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_covered_references(views.boxes(spark, sf_dir)).select("doc", "unique_id")


@query
def region_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.boxes(spark, sf_dir).groupBy(L.route(F.col("class_name")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query
def text_only_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.text_only_pages(views.boxes(spark, sf_dir)).select("doc", "full_page")


@query
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.boxes(spark, sf_dir).withColumn("text", F.concat_ws(" ", "class_name", F.col("unique_id").cast("string")))
    return L.page_markdown(rows).select("doc", "markdown")


@query
def nms_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.suppressed(views.boxes(spark, sf_dir)).select("doc", "unique_id")


@query
def clamped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sure_boxes(views.boxes(spark, sf_dir), 60, 50, 0.05).select("doc", "unique_id", "x1", "y1", "x2", "y2")


# evaluation


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the one whose number follows."""
    b = table(spark, sf_dir, "benchmark")
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hyp")), "item_id")


@query
def ned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in ASCII, as the SQL counts bytes."""
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "x")
    return _pairs(spark, sf_dir).select("item_id", _r(E.page_ned(plain("text"), plain("hyp")), "ned"))


@query
def bleu_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against itself with the next one behind it."""
    return _pairs(spark, sf_dir).select("item_id", _r(E.bleu4(F.col("text"), F.concat_ws(" ", "text", "hyp")), "bleu"))


@query
def cdm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrap = lambda c: F.concat(F.lit("$\\mathbf{"), F.col(c), F.lit("}$"))
    return _pairs(spark, sf_dir).select("item_id", _r(E.cdm(wrap("text"), wrap("hyp")), "cdm"))


@query
def eval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        ((i % 10) / 10.0).alias("ned"), ((i % 7) / 7.0).alias("bleu"), F.when(i % 3 != 0, (i % 100).cast("double")).alias("text"), F.when(i % 4 == 0, (i % 90).cast("double")).alias("table"), F.when(i % 5 == 0, (i % 80).cast("double")).alias("formula")
    )
    d = d.withColumn("composite", E.composite(F.col("text"), F.col("table"), F.col("formula"), F.col("text") > 50))
    m = E.means(d)
    return m.select("n_pages", *[_r(F.col(c), c) for c in m.columns if c != "n_pages"])


# events


@query
def event_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"))
    return I.latest_state(e).select(F.col("key").alias("user_id"), F.col("at").alias("last_event"), "n_events")


@query
def heartbeat_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("service_type"), F.col("user_id").cast("string").alias("url"), F.col("ts").alias("at"))
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return S.health(e, now, 86400).select("service_type", "url", "healthy")


@query
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("at"))
    return I.first_of_each(e).withColumnRenamed("at", "event_id")


@query
def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums over payloads that went through the stream's parser."""
    e = table(spark, sf_dir, "events")
    payload = F.to_json(F.struct(F.col("event_id").cast("string").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("size_bytes"), F.col("event_type").alias("source")))
    lines = e.select(F.lit("ingested").alias("subject"), payload.alias("payload"), F.col("ts").alias("at"))
    rows = I.parsed(lines, "ingested").where("size_bytes IS NOT NULL")
    return rows.groupBy(F.col("source").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("total"))


@query
def table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tables of two rows against the table of the next line number."""
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    html = F.concat(F.lit("<table><tr>"), cell("l_partkey"), cell("l_suppkey"), F.lit("</tr><tr>"), cell("l_quantity"), cell("l_returnflag"), F.lit("</tr></table>"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", html.alias("truth"))
    nxt = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("truth").alias("found"))
    ids = ["l_orderkey", "l_linenumber"]
    return E.table_scores(rows.join(nxt, ids), ids).select(*ids, _r(F.col("teds"), "teds"))


@query
def resolved_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.operators.downloads import resolved

    none = F.lit(None).cast("string")
    return resolved(views.papers(spark, sf_dir).withColumns({"unpaywall": none, "pmc_url": F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("pmc/"), "id"))})).select("id", "url", "resolver")


@query
def stamped_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document embedded anew, with no chunks for every tenth."""
    from scholia.operators.stamps import stamp_embedding

    d = table(spark, sf_dir, "documents")
    results = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stem"), F.lit("gpu").alias("server"), F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("doc_id") % 9).alias("chunks"), F.lit("cpu").alias("device"))
    out = stamp_embedding(views.catalog(spark, sf_dir), results, F.lit("2024-05-01T00:00:00Z"))
    return out.select("stem", F.col("embedding.chunks_indexed").alias("chunks"), F.col("embedding_skip.reason").alias("skip_reason"))
