"""Intermediate tables in the folder that the cluster shares, which cut the lineage and are read instead of worked out anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; only a local session may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file:///tmp/checkpoints/scholia"
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
