"""The document pipeline: rules, near duplicates, repeated passages, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.mixing import mix
from scholia.llm.near_join import near_join
from scholia.llm.packing import pack
from scholia.llm.quality_rules import quality_rules
from scholia.llm.staging import forget_path, new_path, settled, stage_tables, staged
from scholia.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    # through a generator: the filter would be pushed down otherwise, and the measures worked out twice
    judged = quality_rules(docs).select(*COLUMNS, F.explode(F.array("kept")).alias("_kept"))
    return judged.where("_kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays, and of its repeated rows one.

    Rows without an id are in no class, and stay.
    """
    found = settled(spark, lambda: near_join(docs).select("doc_id", "class_id").where("doc_id IS NOT NULL"), "classes")
    of_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min((F.col("doc_id") == F.col("class_id")).cast("int")).alias("stays"))
    stay = staged(of_id.where("stays = 1").select("doc_id", "n"), "stay")
    rows = docs.select(*COLUMNS)
    # merged at every size: ids grow with the documents, and a broadcast would fit small inputs alone
    once = rows.join(stay.where("n = 1").select("doc_id").hint("merge"), "doc_id").unionByName(rows.where("doc_id IS NULL"))
    if stay.where("n > 1").isEmpty():
        return once.select(*COLUMNS)
    again = rows.join(stay.where("n > 1").select("doc_id").hint("merge"), "doc_id").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that came before go from the texts; a document of which nothing is left goes."""
    cut = substring_dedup(docs)
    some = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where((F.col("n_cut") == 0) | some).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The files hold the documents in the order in which the sources interleave."""
    return mix(docs).repartitionByRange("position").sortWithinPartitions("position").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins, packed along the mixed order."""
    return pack(docs, in_order=True)


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("repeated passages", repeats), ("mixing", mixing), ("packing", packing)]

#: Chosen paths and content-defined chunks have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with stage_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            forget_path(spark, last)
        last = path
    return docs
