"""Points in buckets by document, with versions: an upsert writes the buckets that it meets and no other file.

The table is a folder of bucket folders, each file set named by the write that made it, and
of manifests, one a version: for each bucket the files that hold it.  A version comes into
being by one rename of its manifest, so readers of an older version see nothing of a write
in progress, and of two writers from one version the second one's rename finds the name
taken and plans again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionTaken(Exception):
    """Another writer has committed this version first."""


class PointTable:
    """Points with doc_id, point_id and indexed_at, among other columns, below `path`."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """The newest version; 0 for an empty table."""
        found = self._fs.globStatus(self._path("manifests", "*.json")) or []
        return max((int(f.getPath().getName().removesuffix(".json")) for f in found), default=0)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has points: a bounded map, an entry a bucket."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path("manifests", f"{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        self.buckets = held["buckets"]
        return {int(k): v for k, v in held["folders"].items()}

    def _commit(self, folders: dict[int, str], version: int) -> None:
        self._fs.mkdirs(self._path("manifests"))
        part = self._path("manifests", f".{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "folders": folders}).encode()))
        out.close()
        to = self._path("manifests", f"{version}.json")
        # a rename doesn't replace what is there on HDFS; elsewhere the look before it narrows the gap
        if self._fs.exists(to) or not self._fs.rename(part, to):
            self._fs.delete(part, False)
            raise VersionTaken(str(version))

    def bucket(self, doc):
        return F.pmod(F.xxhash64(doc.cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def points(self, version: int | None = None, docs: list | None = None) -> DataFrame | None:
        """All points of a version, or those of a few documents from their buckets alone; None for an empty table."""
        folders = self.manifest(version)
        if not folders:
            return None
        schema = self.spark.read.parquet(f"{self.path}/{next(iter(folders.values()))}").schema
        if docs is None:
            return self._read(list(folders.values()), schema)
        ids = self.spark.createDataFrame([(d,) for d in docs], "doc_id string")
        met = {r[0] for r in ids.select(self.bucket(F.col("doc_id"))).distinct().collect()} & folders.keys()
        if not met:
            return self._read(list(folders.values())[:1], schema).limit(0)
        return self._read([folders[b] for b in met], schema).where(F.col("doc_id").cast("string").isin([str(d) for d in docs]))

    def _write(self, rows: DataFrame, version: int, met: set[int], folders: dict[int, str]) -> int:
        name = f"write={uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self.bucket(F.col("doc_id")))
        # one task a bucket and part of it; files are sorted, so that filters by document skip row groups
        dealt.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "point_id").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        written = {int(f.getPath().getName().removeprefix("bucket=")) for f in self._fs.globStatus(self._path(name, "bucket=*")) or []}
        kept = {b: f for b, f in folders.items() if b not in met} | {b: f"{name}/bucket={b}" for b in written}
        self._commit(kept, version + 1)
        return version + 1

    def upsert(self, new: DataFrame, replaced: DataFrame | None = None) -> int:
        """Put points in, each document of `new` (and of `replaced`, doc_id) as a whole; the version that holds them.

        Of repeated points the newest by indexed_at counts.  Only the buckets of these
        documents are read and written anew.
        """
        version = self.version()
        folders = self.manifest(version)
        latest = Window.partitionBy("point_id").orderBy(F.desc("indexed_at"))
        fresh = new.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
        docs = new.select(F.col("doc_id").cast("string").alias("doc_id"))
        if replaced is not None:
            docs = docs.unionByName(replaced.select(F.col("doc_id").cast("string").alias("doc_id")))
        docs = docs.distinct()
        met = {r[0] for r in docs.select(self.bucket(F.col("doc_id"))).distinct().collect()}  # a row a bucket
        old = [folders[b] for b in met if b in folders]
        rows = fresh
        if old:
            gone = docs.withColumnRenamed("doc_id", "_gone")
            stay = self._read(old, new.schema)
            rows = stay.join(gone, stay["doc_id"].cast("string") == gone["_gone"], "left_anti").unionByName(fresh)
        if not met:
            return version
        return self._write(rows, version, met, folders)

    def delete(self, docs: DataFrame) -> int:
        """Take documents (doc_id) out; the version without them."""
        folders = self.manifest()
        if not folders:
            return self.version()
        schema = self.spark.read.parquet(f"{self.path}/{next(iter(folders.values()))}").schema
        return self.upsert(self.spark.createDataFrame([], schema), docs)
