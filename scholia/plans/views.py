"""Papers, catalog rows, listings and pages derived from the driver's tables, once for all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.schemas import AUTHORS, PAGE_SEPARATOR

SOURCES = ["arxiv", "openalex", "semantic_scholar", "crossref", "europe_pmc", "core"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table that is dealt out anew, for each core.
SMALL = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, where the table is too small to be read by them all.

    A file of few row groups is read by few tasks, and what they work out for each text
    would be, too.  Only a table of known, small size is shuffled for that.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= SMALL * cores else rows


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows by a key, in several small parts for each core: what is worked out for a key may take very unlike times."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(cores, min(8 * cores, size >> 18), size >> 22), key)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bibliographic records of six sources; the title is the first sentence, at most 120 characters of it."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    author = lambda k: F.struct(F.concat(F.lit("author "), k.cast("string")).alias("name"), F.array().cast("array<string>").alias("affiliations"))
    prefix = F.when(i % 4 == 1, "https://doi.org/").otherwise("")
    return d.select(
        F.concat(F.lit("p"), i.cast("string")).alias("id"),
        F.regexp_extract("text", r"^[^.\n]{0,120}", 0).alias("title"),
        F.transform(F.sequence(F.lit(1), (i % 4 + 1).cast("int")), author).cast(AUTHORS).alias("authors"),
        F.when(i % 7 != 0, F.col("text")).alias("abstract_text"),
        F.when(i % 11 != 0, F.date_add(F.lit("2015-01-01").cast("date"), (i % 3000).cast("int"))).alias("publication_date"),
        F.when(i % 3 != 0, F.concat(prefix, F.lit("10.1/AB"), F.floor(i / 2).cast("string"))).alias("doi"),
        F.when(i % 4 != 0, F.array(F.concat(F.lit("http://x/"), (i % 10).cast("string")), F.concat(F.lit("http://y/"), F.floor(i / 2).cast("string")))).otherwise(F.array().cast("array<string>")).alias("download_urls"),
        F.when(i % 5 != 0, (i * 37) % 1000).alias("cited_by_count"),
        F.get(F.array(*map(F.lit, SOURCES)), (i % 6).cast("int")).alias("source"),
        F.floor(i / 6).cast("int").alias("rank"),
        "doc_id",
    )


def _stamp(month: str):
    return F.concat(F.lit(f"2024-{month}-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog row for each document, its stages by arithmetic on the id and its failures by the label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    i = F.col("doc_id")
    stem = F.concat(F.lit("d"), i.cast("string"))
    failed = F.coalesce(F.col("quality") == 0, F.lit(False))
    conversion = F.struct(
        _stamp("02").alias("converted_at"), F.when(i % 4 == 0, "local-html").otherwise("vlm").alias("server"), ((i % 50) / 10.0).cast("double").alias("duration_secs"), (i % 5 + 1).alias("total_pages"),
        failed.alias("failed"), F.when(failed, "repetition_loop").alias("reason"),
    )
    embedding = F.struct(_stamp("03").alias("embedded_at"), F.lit("gpu").alias("server"), (i % 7).alias("chunks_indexed"), F.lit("cuda").alias("compute_device"))
    skip = F.struct(_stamp("03").alias("at"), F.when(i % 8 == 1, "embed_failed: memory").otherwise("zero_chunks").alias("reason"))
    return d.select(
        stem.alias("stem"),
        F.when(i % 9 != 0, F.concat(F.lit("Title "), i.cast("string"))).alias("title"),
        F.when(i % 3 != 0, F.concat(F.lit("10.1/AB"), F.floor(i / 2).cast("string"))).alias("doi"),
        F.when(i % 8 != 0, _stamp("01")).alias("downloaded_at"),
        F.col("n_chars").alias("file_size_bytes"),
        F.when(i % 10 == 0, F.concat(F.lit("markdown/"), stem, F.lit(".md"))).when(i % 10 != 1, F.concat(F.lit("markdown/"), F.substring(stem, 1, 2), F.lit("/"), stem, F.lit(".md"))).alias("markdown_path"),
        F.when(i % 6 != 0, conversion).alias("conversion"),
        F.when((i % 6 != 0) & (i % 4 != 1), embedding).alias("embedding"),
        F.when((i % 4 == 1) & (i % 12 != 5), skip).alias("embedding_skip"),
        F.when(i % 50 == 0, F.struct(_stamp("04").alias("at"), F.lit("path").alias("reason"))).alias("repair"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of source and markdown files: sharded, unsharded, hidden, and some that no catalog row knows."""
    i = F.col("doc_id")
    n = i.cast("string")
    stem = F.concat(F.lit("d"), n)
    shard = F.substring(stem, 1, 2)
    path = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    keys = F.array(
        F.when(i % 7 != 0, path("papers/", shard, "/", stem, ".pdf")),
        F.when(i % 5 == 0, path("papers/", shard, "/", stem, ".html")),
        F.when(i % 20 == 0, path("papers/", shard, "/._", stem, ".pdf")),
        F.when(i % 25 == 0, path("papers/zz/x", n, ".pdf")),
        F.when((i % 6 != 0) & (i % 13 != 0), path("markdown/", shard, "/", stem, ".md")),
        F.when(i % 10 == 0, path("markdown/", stem, ".md")),
        F.when(i % 30 == 0, path("markdown/zz/x", n, ".md")),
    )
    rows = table(spark, sf_dir, "documents").select(F.explode(F.array_compact(keys)).alias("key"), "n_chars")
    return rows.select("key", F.col("n_chars").alias("size"))


def of_prefix(listing: DataFrame, prefix: str) -> DataFrame:
    return listing.where(F.startswith("key", F.lit(prefix + "/")))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents in the vector table."""
    i = F.col("doc_id")
    ids = F.array(F.when((i % 6 != 0) & (i % 4 != 1) & (i % 17 != 0), F.concat(F.lit("d"), i.cast("string"))), F.when(i % 40 == 0, F.concat(F.lit("gone"), i.cast("string"))))
    return table(spark, sf_dir, "documents").select(F.explode(F.array_compact(ids)).alias("doc_id"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged markdown: one page for each turn."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    joined = F.array_join(F.transform(turns, lambda x: x["text"]), PAGE_SEPARATOR)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined.alias("markdown"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as regions of a page, one page for each order."""
    names = F.array(*map(F.lit, ["text", "table", "reference", "reference_content", "display_formula", "image", "header"]))
    x = (F.col("l_partkey") % 40).cast("double")
    y = (F.col("l_suppkey") % 30).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc"), F.lit(1).alias("page"), x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + F.col("l_quantity")).alias("y2"),
        F.col("l_discount").alias("confidence"), F.get(names, (F.col("l_partkey") % 7).cast("int")).alias("class_name"), F.col("l_linenumber").cast("double").alias("read_order"), F.col("l_linenumber").cast("int").alias("unique_id"),
    )
