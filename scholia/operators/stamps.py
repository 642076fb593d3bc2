"""Outcomes of conversion and embedding written into catalog rows, and rewrites of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import pages_of, sharded_key, title_of_markdown
from scholia.operators.catalog import encoded_twins


def stamp_conversion(catalog: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """catalog with the conversion of results (stem, server, duration_secs, total_pages, outcome, key).

    An outcome other than ok is a failed stamp with that reason and leaves the path alone.
    """
    ok = F.col("_o") == "ok"
    r = results.select("stem", *[F.col(c).alias("_" + c[0]) for c in ("server", "duration_secs", "total_pages", "outcome", "key")])
    new = F.struct(at.alias("converted_at"), F.col("_s").alias("server"), F.col("_d").cast("double").alias("duration_secs"), F.col("_t").cast("long").alias("total_pages"), (~ok).alias("failed"), F.when(~ok, F.col("_o")).alias("reason"))
    rows = catalog.join(r, "stem", "left")
    path = F.when(ok, F.col("_k")).otherwise(F.col("markdown_path"))
    return rows.withColumn("conversion", F.when(F.col("_o").isNotNull(), new).otherwise(F.col("conversion"))).withColumn("markdown_path", path).select(*catalog.columns)


def stamp_embedding(catalog: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """catalog with the embedding of results (stem, server, chunks, device): a stamp for some chunks, a skip for none.

    A later success doesn't clear an earlier skip.
    """
    r = results.select("stem", F.col("server").alias("_s"), F.col("chunks").cast("long").alias("_n"), F.col("device").alias("_d"))
    done = F.struct(at.alias("embedded_at"), F.col("_s").alias("server"), F.col("_n").alias("chunks_indexed"), F.col("_d").alias("compute_device"))
    skip = F.struct(at.alias("at"), F.lit("zero_chunks").alias("reason"))
    rows = catalog.join(r, "stem", "left").withColumn("embedding", F.when(F.col("_n") > 0, done).otherwise(F.col("embedding")))
    return rows.withColumn("embedding_skip", F.when(F.col("_n") == 0, skip).otherwise(F.col("embedding_skip"))).select(*catalog.columns)


def without_encoded_twins(catalog: DataFrame) -> DataFrame:
    """The catalog without rows whose percent-decoded stem has a row of its own; vectors stay as they are."""
    return catalog.join(encoded_twins(catalog).select("stem"), "stem", "left_anti")


def rows_from_markdown(markdown: DataFrame, catalog: DataFrame) -> DataFrame:
    """(stem, title, total_pages, key) of markdown (stem, key, markdown) that the catalog doesn't know."""
    new = markdown.join(catalog.select("stem"), "stem", "left_anti")
    return new.select("stem", title_of_markdown("markdown").alias("title"), F.size(pages_of("markdown")).alias("total_pages"), "key")


def shard_moves(objects: DataFrame, prefix: str) -> DataFrame:
    """(key, target) of files that lie flat below the prefix; stems of one character stay."""
    name = F.regexp_extract("key", rf"^{prefix}/([^/]+)$", 1)
    stem, ext = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.regexp_extract(name, r"\.([^.]*)$", 1)
    moved = objects.where(F.length(stem) >= 2).select("key", F.concat(sharded_key(stem, "", prefix), ext).alias("target"))
    return moved
