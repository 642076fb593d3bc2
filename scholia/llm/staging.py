"""Written intermediate tables in the folder that the cluster shares.

Tables cut the lineage, so that a lost executor costs a reread and no long
recomputation.  The folder is the session's spark.checkpoint.dir; where it is
unset and the session is local, as in tests, one below /tmp/checkpoints is set.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where the setting is missing, in a local session.
LOCAL_DIR = "file:///tmp/checkpoints/scholia"

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from the session's setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = LOCAL_DIR
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has."""
    path = f"{shared_dir(spark)}/scholia/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table by the file system that its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    if path in _written:
        _written.remove(path)
    delete_path(spark, path)


def forget(df: DataFrame) -> None:
    """Delete one intermediate table that staged() returned and nothing reads any more."""
    for file in df.inputFiles()[:1]:
        for path in list(_written):
            if path.split("/scholia/")[-1] in file:
                forget_path(df.sparkSession, path)


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the intermediate tables that were written within; nothing may read them any more."""
    before = set(_written)
    yield
    for path in [x for x in _written if x not in before]:
        forget_path(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of make() as a written table; the tables that make() wrote on the way are deleted."""
    path = new_path(spark, name)
    with stage_tables(spark):
        rows = make()
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
