"""More registered queries: sources, catalog rewrites, small columns, outputs; more_oracle.py has their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import tables as TB
from scholia.functions import text as T
from scholia.operators import catalog as C
from scholia.operators import evaluate as E
from scholia.operators import layout as L
from scholia.operators import quality as Q
from scholia.operators import stamps
from scholia.operators import vectors as V
from scholia.plans import views
from scholia.plans.indexing import with_metadata
from scholia.plans.metasearch import all_sources, by_doi, ranked_by_place
from scholia.plans.queries import _first_vector, _pairs, _r, _tables, query
from scholia.plans.views import table
from scholia.sources import inbox, outputs, providers


def _stem():
    return F.concat(F.lit("d"), F.col("doc_id").cast("string"))


# sources


@query
def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(_stem().alias("doc_id"), "text")
    return with_metadata(docs, views.catalog(spark, sf_dir), this_year=2024).select("doc_id", "title", "doi", "year", "pdf_path")


@query
def source_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.papers(spark, sf_dir).withColumn("place", (F.col("doc_id") * 7919) % 1009)
    return ranked_by_place(rows, "place").select("id", "source", F.col("rank").cast("int").alias("rank"))


@query
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers put together again from the answers of five sources, of which one has failed."""
    papers = views.papers(spark, sf_dir)
    answers = {s: papers.where(F.col("source") == s) if s != "core" else TimeoutError("slow") for s in views.SOURCES}
    rows, report = all_sources(answers)
    return report.join(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left").select("source", "ok", "n")


@query
def doi_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_doi(views.papers(spark, sf_dir), "10.1/AB10").select("id", "title", "source", "cited_by_count", _r(F.col("rrf"), "rrf"))


def _payloads(spark: SparkSession, sf_dir: str, *fields) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.to_json(F.struct(*fields)).alias("payload"))


def _id():
    return F.col("doc_id").cast("string")


def _doi():
    return F.concat(F.lit("10.1/"), _id())


def _title():
    return F.concat(F.lit("Title "), _id())


def _kept(rows: DataFrame, *more) -> DataFrame:
    return rows.select("id", "title", "abstract_text", F.col("publication_date").cast("string").alias("publication_date"), "doi", F.array_join("download_urls", " ").alias("urls"), "cited_by_count", *more)


@query
def provider_openalex(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.create_map(F.lit("alpha"), F.array(F.lit(0), F.lit(2)), F.concat(F.lit("w"), _id()), F.array(F.lit(1)))
    places = F.array(F.struct(F.concat(F.lit("p"), _id()).alias("pdf_url")), F.struct(F.lit("best").alias("pdf_url")))
    rows = _payloads(
        spark, sf_dir, F.concat(F.lit("https://openalex.org/W"), _id()).alias("id"), _title().alias("display_name"), F.concat(F.lit("https://doi.org/"), _doi()).alias("doi"), F.lit("2020-05-17").alias("publication_date"),
        F.col("n_chars").alias("cited_by_count"), index.alias("abstract_inverted_index"), F.struct(F.lit("best").alias("pdf_url")).alias("best_oa_location"), places.alias("locations"),
    )
    return _kept(providers.openalex(rows))


@query
def provider_semantic_scholar(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.struct(F.when(F.col("doc_id") % 2 == 0, _doi()).alias("DOI"), _id().alias("ArXiv"))
    rows = _payloads(spark, sf_dir, _id().alias("paperId"), _title().alias("title"), F.col("text").alias("abstract"), (1990 + F.col("doc_id") % 30).alias("year"), F.col("n_chars").alias("citationCount"), ids.alias("externalIds"))
    return _kept(providers.semantic_scholar(rows))


@query
def provider_europe_pmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = lambda style, url: F.struct(F.lit(style).alias("documentStyle"), url.alias("url"))
    urls = F.struct(F.array(link("html", F.lit("h")), link("pdf", F.concat(F.lit("p"), _id()))).alias("fullTextUrl"))
    rows = _payloads(spark, sf_dir, _id().alias("id"), _title().alias("title"), F.lit("A B, C D.").alias("authorString"), F.lit("2019-01-02").alias("firstPublicationDate"), _doi().alias("doi"), F.col("n_chars").alias("citedByCount"), urls.alias("fullTextUrlList"))
    return _kept(providers.europe_pmc(rows), F.array_join(F.transform("authors", lambda a: a["name"]), ";").alias("authors"))


@query
def provider_crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.struct(F.array(F.array(F.lit(2000) + F.col("doc_id") % 20, F.col("doc_id") % 12 + 1)).alias("date-parts"))
    link = F.array(F.struct(F.concat(F.lit("p"), _id()).alias("URL"), F.when(F.col("doc_id") % 2 == 0, "application/pdf").otherwise("text/html").alias("content-type")))
    rows = _payloads(spark, sf_dir, _doi().alias("DOI"), F.array(_title()).alias("title"), day.alias("published"), F.col("n_chars").alias("is-referenced-by-count"), link.alias("link"))
    return _kept(providers.crossref(rows))


@query
def provider_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(spark, sf_dir, F.col("doc_id").alias("id"), _title().alias("title"), F.when(F.col("doc_id") % 3 > 0, F.lit(2010)).alias("yearPublished"), _doi().alias("doi"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("u").alias("downloadUrl"))
    return _kept(providers.core(rows))


@query
def provider_arxiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = F.concat(F.lit('<feed><entry><id>http://arxiv.org/abs/2001.'), _id(), F.lit("v2</id><title>Title\n  of "), _id(), F.lit("</title><summary> s </summary><published>2020-01-05T00:00:00Z</published></entry></feed>"))
    return providers.arxiv(table(spark, sf_dir, "documents").select(feed.alias("payload"))).select("id", "title", "abstract_text", F.col("publication_date").cast("string").alias("publication_date"), "doi")


# catalog and points


@query
def repair_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repair_samples(C.repair_plan(*_tables(spark, sf_dir))).select("direction", "stem", F.col("n").cast("int").alias("n"))


@query
def catalog_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(_stem().alias("stem"))
    return C.delete(views.catalog(spark, sf_dir), gone).select("stem")


@query
def reconcile_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, _, md = _tables(spark, sf_dir)
    return C.reconcile_actions(C.reconcile(md, views.indexed(spark, sf_dir), cat))


@query
def catalog_without_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    stems = F.array(F.concat(F.lit("a b"), n), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a%20b"), n)), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("c%20"), n)))
    return stamps.without_encoded_twins(table(spark, sf_dir, "documents").select(F.explode(F.array_compact(stems)).alias("stem")))


@query
def shard_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps.shard_moves(views.objects(spark, sf_dir), "markdown")


@query
def conversion_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    results = d.select(_stem().alias("stem"), F.lit("vlm").alias("server"), F.lit(1.5).alias("duration_secs"), (i % 4).alias("total_pages"), F.when(i % 4 == 0, "stub").otherwise("ok").alias("outcome"), F.concat(F.lit("m/"), _stem()).alias("key"))
    out = stamps.stamp_conversion(views.catalog(spark, sf_dir), results, F.lit("2024-06-01T00:00:00Z"))
    return out.select("stem", "markdown_path", F.col("conversion.total_pages").alias("pages"), F.col("conversion.failed").alias("failed"), F.col("conversion.reason").alias("reason"))


@query
def points_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.purge(table(spark, sf_dir, "embeddings"), ["1", "7", "no"], "vec_id").select("vec_id")


@query
def vector_topk_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").withColumn("topics", F.array(F.concat(F.lit("t"), F.col("label").cast("string")))).withColumn("year", (2000 + F.col("vec_id") % 20).cast("int"))
    return V.top_k(points, _first_vector(spark, sf_dir), 5, "vec_id", year=">=2005", topic="t3").select("vec_id", "label", "year", _r(F.col("score"), "score"))


@query
def inbox_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ends = F.array(*map(F.lit, ["pdf", "HTML", "epub", "part", "txt", "mobi"]))
    name = F.concat(F.when(i % 11 == 0, "._").otherwise(""), F.lit("Ab"), _id(), F.lit("."), F.get(ends, (i % 6).cast("int")))
    key = F.concat(F.when(i % 7 == 0, "papers/x/").otherwise("papers/manually_downloaded/"), name)
    now = F.lit("2024-01-01 00:01:00").cast("timestamp")
    listing = table(spark, sf_dir, "documents").select(key.alias("key"), (now - F.make_dt_interval(secs=(i % 9).cast("decimal(18,6)"))).alias("last_modified"))
    return inbox.classified(listing, now).select("key", "outcome", "target_key")


@query
def processable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.objects(spark, sf_dir).where(inbox.processable(F.col("key"))).select("key")


# texts and pages


@query
def reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.with_quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", Q.reason_text(rows).alias("reason")).where("reason IS NOT NULL")


@query
def identifier_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 4 == 0, _doi()).when(i % 4 == 1, F.concat(F.lit("2001."), _id())).when(i % 4 == 2, F.concat(F.lit("10.48550/ArXiv."), _id())).otherwise(F.concat(F.lit("a/b:"), _id()))
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_like_doi(name).alias("is_doi"), T.looks_like_arxiv_id(name).alias("is_arxiv"), T.arxiv_id_of_doi(name).alias("arxiv_id"), T.file_name(name).alias("file_name"))


@query
def small_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    size = T.downscaled(n, F.lit(500), 1000)
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.age_text(n * 37).alias("age"), T.bytes_text(n * 1000).alias("size"), size["width"].alias("width"), size["height"].alias("height"), T.pixels(n, 144).alias("pixels"),
        T.collapsed_digits(F.concat(_id(), F.lit(". 5 and 7 ."), _id())).alias("digits"),
    )


@query
def markdown_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("\n  ## Conversation "), F.col("conv_id").cast("string"), F.lit(" \n"))
    return views.markdown(spark, sf_dir).select("conv_id", T.title_of_markdown(F.concat(head, "markdown")).alias("title"))


@query
def tag_free_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.without_tags("html").alias("plain"))


@query
def table_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table from structure tokens and cell texts, and its canonical form."""
    tokens = F.array(*map(F.lit, ['<thead class="x"><tr>', "<td></td>", "<td", ' colspan="2"', ">", "</td>", "<td></td>", "</tr></thead>"]))
    html = T.table_html(tokens, F.array(F.concat(F.lit("<b>"), F.col("l_partkey").cast("string"), F.lit("</b>")), F.col("l_returnflag")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", html.alias("html"), TB.canonical_table(html).alias("canonical"))


@query
def numbered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.numbered(views.boxes(spark, sf_dir).withColumn("read_order", F.col("x1"))).select("doc", "read_order", "unique_id")


@query
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "x")
    return _pairs(spark, sf_dir).select("item_id", _r(E.text_score(plain("text"), plain("hyp")), "score"))


@query
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    pages = table(spark, sf_dir, "documents").select(
        F.when(i % 2 == 0, "even").otherwise("odd").alias("dataset"), ((i % 10) / 10.0).alias("ned"), F.lit(0.5).alias("bleu"), ((i % 3) * 10.0).cast("double").alias("composite"), F.lit(1.0).alias("text"), F.when(i % 4 == 1, (i % 90).cast("double")).alias("table"), F.lit(None).cast("double").alias("formula")
    )
    out = E.report(pages)
    return out.select("dataset", "n_pages", *[_r(F.col(c), c) for c in out.columns if c.startswith("mean_")])


@query
def tab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.tab_lines(views.papers(spark, sf_dir))


@query
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.json_lines(views.papers(spark, sf_dir).select("id", "doi", "cited_by_count"))
