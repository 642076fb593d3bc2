"""Objects of a store and text documents, read by Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.text import sharded_key
from scholia.schemas import CATALOG


def list_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """key, size, last_modified of all files below a path of any file system, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """stem, key, markdown of all .md files below a path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("stem"), F.col("_metadata.file_path").alias("key"), F.col("value").alias("markdown")).where(
        ~F.startswith("stem", F.lit("._"))
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows from JSON lines; missing fields are null and unreadable rows are dropped."""
    rows = spark.read.schema(CATALOG + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("stem IS NOT NULL AND _corrupt_record IS NULL").drop("_corrupt_record")


def resolved_keys(catalog: DataFrame, objects: DataFrame, prefix: str) -> DataFrame:
    """stem, key: the stored markdown path if that object exists, else the sharded key."""
    have = objects.select(F.col("key").alias("markdown_path"), F.lit(True).alias("there"))
    rows = catalog.select("stem", "markdown_path").join(have, "markdown_path", "left")
    return rows.select("stem", F.when(F.col("there"), F.col("markdown_path")).otherwise(sharded_key("stem", "md", prefix)).alias("key"))
