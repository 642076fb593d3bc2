"""Size-tiered compaction of document shards, in DataFrame functions alone.

Arrivals are appended as small immutable shards, one file each.  Shards of one size tier
are merged in runs into files of the target size, and every change is one new version of
the manifest, made visible by an atomic rename.

Each attempt to append or to merge writes into a folder of its own, its *batch*, and a
manifest names the shards by batch and number.  So readers of a version see exactly the
rows that its manifest names, whatever other attempts have written, failed or not; an
attempt that was never committed is a folder that nobody reads, and vacuum removes it.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.rows import placed_rows
from scholia.llm.staging import delete_path

#: Bytes of text of an arriving shard and of a merged one.
SMALL_BYTES, TARGET_BYTES = 4 << 20, 32 << 20
#: Shards of a tier that make a merge worth while, if they don't fill a target already.
FAN_IN = 4

MANIFEST = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("batch", T.StringType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("min_id", T.LongType()),
        T.StructField("max_id", T.LongType()),
    ]
)


class VersionTaken(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """A folder of shards with versioned manifests, on a file system whose rename is atomic.

    The rows' columns are kept as one struct, so their names can't clash with the store's.
    Null texts count 0 bytes; null ids are kept; repeated rows stay apart.  Any number of
    writers may append and compact at a time: the first commit of a version wins, and the
    other begins again from it.
    """

    def __init__(self, spark: SparkSession, path: str, small: int = SMALL_BYTES, target: int = TARGET_BYTES, fan_in: int = FAN_IN, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.path, self.small, self.target, self.fan_in = spark, path.rstrip("/"), small, target, fan_in
        self.id_col, self.text_col = id_col, text_col
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._fs_path(f"{self.path}/manifests"))

    # versions

    def versions(self) -> list[int]:
        """The committed versions, oldest first."""
        found = self._fs.listStatus(self._fs_path(f"{self.path}/manifests"))
        return sorted(int(name[2:]) for s in found if (name := s.getPath().getName()).startswith("v="))

    def _newest(self) -> int:
        return (self.versions() or [0])[-1]

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version, the newest by default."""
        version = self._newest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/v={version}")

    def _commit(self, rows: DataFrame, version: int) -> None:
        """Write a manifest aside and rename it into place; VersionTaken if there is such a version."""
        aside = f"{self.path}/uncommitted/{uuid.uuid4().hex}"
        rows.select(*MANIFEST.names).coalesce(1).write.parquet(aside)
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs_path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs_path(aside), self._fs_path(f"{self.path}/manifests/v={version}"), no_options)
        except Py4JJavaError as error:
            delete_path(self.spark, aside)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                raise VersionTaken(version) from None
            raise

    # rows

    def _bytes(self) -> Column:
        return F.coalesce(F.octet_length(F.col("row")[self.text_col]), F.lit(0)).cast("long")

    def _tier(self, n_bytes: Column) -> Column:
        """Powers of the fan-in above the small size; a full target is the top tier."""
        steps = F.floor(F.log(F.greatest(n_bytes, F.lit(1)) / F.lit(float(self.small))) / F.log(F.lit(float(self.fan_in))))
        return F.greatest(F.lit(0), steps).cast("int")

    def _write(self, rows: DataFrame, shards: int) -> str:
        """Write rows (row, number) as one file for each number below `shards`; the batch's name."""
        batch = uuid.uuid4().hex
        rows.repartitionById(max(1, shards), F.col("number")).write.parquet(f"{self.path}/data/batch={batch}")
        return batch

    def _shards(self, batch: str) -> DataFrame:
        """The manifest rows of a batch but for the shards' names, which come with the version."""
        ident = F.col("row")[self.id_col].cast("long")
        own = self.spark.read.parquet(f"{self.path}/data/batch={batch}").groupBy("number")
        own = own.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(self._bytes()).alias("n_bytes"), F.min(ident).alias("min_id"), F.max(ident).alias("max_id"))
        return own.select(F.lit(batch).alias("batch"), "number", self._tier(F.col("n_bytes")).alias("tier"), "n_rows", "n_bytes", "min_id", "max_id")

    def _named(self, batch: str, version: int) -> DataFrame:
        return self._shards(batch).withColumn("shard", F.col("number") + F.lit(version << 32)).select(*MANIFEST.names)

    def append(self, docs: DataFrame) -> int:
        """Add rows as new small shards; the committed version, or the present one if there are no rows."""
        rows = placed_rows(docs)
        total = rows.agg(F.count(F.lit(1)), F.sum(self._bytes())).first()
        if not total[0]:
            return self._newest()
        shards = max(1, -(-(total[1] or 0) // self.small))
        # by place, so that equal rows and rows without an id are dealt to all shards
        batch = self._write(rows.select("row", F.pmod("place", F.lit(shards)).cast("int").alias("number")), shards)
        while True:
            now = self._newest()
            try:
                self._commit(self.manifest(now).union(self._named(batch, now + 1)), now + 1)
                return now + 1
            except VersionTaken:
                continue  # the batch adds to whatever the other writer has made

    def plan(self, version: int | None = None) -> DataFrame:
        """(batch, number, into): the merges that are due, neighbours of a tier up to the target size each.

        Its windows run over the manifest, a row for each shard, and not over documents.
        """
        open_ = self.manifest(version).where(F.col("n_bytes") < self.target // 2)
        before = Window.partitionBy("tier").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        run = F.call_function("div", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)), F.lit(self.target))
        runs = open_.select("batch", "number", "tier", "n_bytes", run.alias("run"))
        due = runs.groupBy("tier", "run").agg(F.count(F.lit(1)).alias("k"), F.sum("n_bytes").alias("b")).where((F.col("k") >= self.fan_in) | ((F.col("k") > 1) & (F.col("b") >= self.target * 3 // 4)))
        # a tier's runs are numbered after those of lower tiers, of which there are few
        lower = Window.partitionBy(F.lit(0)).orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
        first = runs.groupBy("tier").agg((F.max("run") + 1).alias("runs")).select("tier", F.coalesce(F.sum("runs").over(lower), F.lit(0)).alias("first"))
        return runs.join(due.select("tier", "run"), ["tier", "run"]).join(first, "tier").select("batch", "number", (F.col("first") + F.col("run")).cast("int").alias("into"))

    def compact(self) -> int:
        """Merge until no merge is due; one version for each round.  The newest version."""
        while True:
            now = self._newest()
            plan = self.plan(now)
            merges = plan.agg(F.max("into")).first()[0]
            if merges is None:
                return now
            due = plan.select("batch", "number", F.col("into"))
            batch = self._write(self._rows_of(due, "into").select("row", F.col("into").alias("number")), merges + 1)
            rest = self.manifest(now).join(plan, ["batch", "number"], "left_anti")
            try:
                self._commit(rest.select(*MANIFEST.names).union(self._named(batch, now + 1)), now + 1)
            except VersionTaken:
                delete_path(self.spark, f"{self.path}/data/batch={batch}")  # the plan is out of date

    def vacuum(self, grace_seconds: float = 86400) -> None:
        """Remove older versions, and what the newest one doesn't name.

        Batches that no version names are left alone for the time of grace, since a writer
        may be about to commit them.  Of other batches the files of dead shards go, and the
        whole folder where no shard lives.  Nothing may read an older version any more.
        """
        now = self._newest()
        if not now:
            return
        data = self._fs_path(f"{self.path}/data")
        batches = [s for s in self._fs.listStatus(data)] if self._fs.exists(data) else []
        live = {r.batch for r in self.manifest(now).select("batch").distinct().collect()}  # as many as arrivals and merges
        known = {r.batch for v in self.versions() for r in self.manifest(v).select("batch").distinct().collect()}
        for s in batches:
            name = s.getPath().getName().removeprefix("batch=")
            if name not in live and (name in known or s.getModificationTime() < (time.time() - grace_seconds) * 1000):
                self._fs.delete(s.getPath(), True)
        for v in self.versions()[:-1]:
            dead = self.manifest(v).join(self.manifest(now), ["batch", "number"], "left_anti").where(F.col("batch").isin(sorted(live)))
            for r in dead.select("batch", "number").toLocalIterator():
                for f in self._fs.globStatus(self._fs_path(f"{self.path}/data/batch={r.batch}/part-{r.number:05d}-*")):
                    self._fs.delete(f.getPath(), False)
            delete_path(self.spark, f"{self.path}/manifests/v={v}")

    def _rows_of(self, shards: DataFrame, keep: str) -> DataFrame:
        """(row, keep) of the rows of the shards (batch, number, keep), read from their batches alone.

        A batch's shards are one array, which goes to every task: some bytes for a file of
        the target size, so that the documents needn't be shuffled to find their shard.
        """
        names = [r.batch for r in shards.select("batch").distinct().collect()]
        every = shards.groupBy("batch").agg(F.max("number").alias("most")).select("batch", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("number"))
        live = every.join(shards, ["batch", "number"], "left").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("number", keep))).alias("live"))
        data = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/batch={b}" for b in names])
        found = data.withColumn("batch", F.col("batch").cast("string")).join(F.broadcast(live), "batch").withColumn(keep, F.get("live", F.col("number"))[keep])
        return found.where(F.col(keep).isNotNull()).select("row", keep)

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version as (row, shard); there must be a version."""
        return self._rows_of(self.manifest(version).select("batch", "number", "shard"), "shard")


def shard_in_arrivals(docs: DataFrame, path: str, arrivals: int = 4, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> ShardStore:
    """Append docs in so many arrivals, by a hash of the id, compacting after each, and leave the newest version alone."""
    store = ShardStore(docs.sparkSession, path, id_col=id_col, text_col=text_col, **sizes)
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64(id_col), F.lit(arrivals)) == k))
        store.compact()
        store.vacuum(grace_seconds=0)  # there is no other writer
    return store
