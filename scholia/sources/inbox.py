"""What becomes of files in a drop folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import sharded_key

MIN_AGE_SECONDS = 5
#: Extensions of unfinished downloads and of formats that can't be read, and those that can.
UNFINISHED = ["download", "part", "crdownload", "tmp", "azw3", "azw", "mobi"]
READABLE = ["pdf", "html", "htm", "epub"]


def classified(objects: DataFrame, now: Column, prefix: str = "papers") -> DataFrame:
    """objects with outcome (ignored_non_inbox, ignored_unsupported, still_writing or commit) and target_key."""
    name = F.element_at(F.split("key", "/"), -1)
    ext = F.lower(F.regexp_extract("_name", r"\.([^.]*)$", 1))
    rows = objects.withColumn("_name", name).withColumn("_ext", ext).withColumn("_stem", F.regexp_replace("_name", r"\.[^.]*$", ""))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_modified")
    outcome = (
        F.when(~F.startswith("key", F.lit(f"{prefix}/manually_downloaded/")), "ignored_non_inbox")
        .when(F.startswith("_name", F.lit("._")) | ~F.contains("_name", F.lit(".")) | F.col("_ext").isin(UNFINISHED) | ~F.col("_ext").isin(READABLE), "ignored_unsupported")
        .when((age >= 0) & (age < MIN_AGE_SECONDS), "still_writing")
        .otherwise("commit")
    )
    html, other = sharded_key("_stem", "html", prefix), F.concat(sharded_key("_stem", "", prefix), F.col("_ext"))
    target = F.when(F.col("outcome") == "commit", F.when(F.col("_ext") == "epub", html).otherwise(other))
    return rows.withColumn("outcome", outcome).withColumn("target_key", target).drop("_name", "_ext", "_stem")


def sweep_report(rows: DataFrame) -> DataFrame:
    """Files of each outcome."""
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def processable(key: Column) -> Column:
    """Whether a file can be converted: a readable kind, neither hidden nor unfinished nor set aside as corrupted."""
    name = F.element_at(F.split(key, "/"), -1)
    kind = F.regexp_extract(name, r"[.]([^.]*)$", 1)
    return kind.isin(READABLE) & ~F.startswith(name, F.lit("._")) & ~F.contains(key, F.lit("/corrupted/"))


def without_unfinished(objects: DataFrame) -> DataFrame:
    """The processable files of a listing beside which no download of the same stem is under way."""
    stem = F.regexp_replace("key", r"[.][^./]*$", "")
    going = objects.where(F.endswith("key", F.lit(".pdf.tmp"))).select(F.regexp_replace("key", r"[.]pdf[.]tmp$", "").alias("_stem")).distinct()
    return objects.where(processable(F.col("key"))).withColumn("_stem", stem).join(going, "_stem", "left_anti").select(*objects.columns)
