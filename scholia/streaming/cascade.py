"""Three topics, each feeding the next: ingested files, converted documents, indexed documents.

A topic is a folder of JSON lines (schemas.EVENT_LINE).  Every step is a stream of its own
with its own checkpoint.  A batch writes its tables and its events into folders of its
number and overwrites them, so a batch that runs again leaves the same.  What a batch
reads follows the batch: its events name the folder that holds their documents, and what
is converted already is told by a small file for each document.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from hashlib import sha1

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from scholia.functions.text import sharded_key
from scholia.plans.indexing import Embedder, index_documents
from scholia.schemas import COMPLETED
from scholia.streaming.ingest import converted, events, parsed, run_to, without_repeats

INGESTED_TOPIC, CONVERTED_TOPIC, INDEXED_TOPIC = "ingested", "converted", "indexed"
MARKDOWN = "stem string, key string, source_key string, markdown string, total_pages int, outcome string"

#: From events (key, ...) to their files: key, html, duration.
Fetch = Callable[[DataFrame], DataFrame]


def topic(root: str, name: str) -> str:
    return f"{root}/topics/{name}"


def publish(rows: DataFrame, path: str, subject: str, at: Column, *fields: str) -> None:
    """Write one event of the fields for each row, of the time `at`; the folder is replaced as a whole."""
    line = rows.select(F.lit(subject).alias("subject"), F.to_json(F.struct(*fields)).alias("payload"), at.alias("at"))
    line.write.mode("overwrite").json(path)


def _newest(batch: DataFrame) -> Column:
    """The time of a batch's last event: the same when the batch runs again."""
    return F.lit(batch.agg(F.max("at")).first()[0]).cast("timestamp")


class Marks:
    """A small file for each converted document below root/done, which holds the number of its batch."""

    def __init__(self, root: str):
        self.root = root

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.root}/done")

    @staticmethod
    def _name(stem: str) -> str:
        name = sha1(stem.encode()).hexdigest()
        return f"{name[:2]}/{name}"

    def unmarked(self, rows: DataFrame, number: int) -> DataFrame:
        """rows (stem, ...) without those of documents that a batch before this one converted."""
        ours = self

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store, base = ours._open()
            for batch in batches:
                keep = []
                for stem in batch["stem"]:
                    try:
                        with store.open_input_stream(f"{base}/{ours._name(stem)}") as mark:
                            keep.append(int(mark.read()) >= number)
                    except FileNotFoundError:
                        keep.append(True)
                yield batch[keep]

        return rows.mapInPandas(task, rows.schema)

    def mark(self, rows: DataFrame, number: int) -> None:
        """Mark the documents of rows (stem) as converted by a batch."""
        ours = self

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store, base = ours._open()
            for batch in batches:
                for stem in batch["stem"]:
                    path = f"{base}/{ours._name(stem)}"
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(path) as out:
                        out.write(str(number).encode())
                yield batch

        rows.select("stem").mapInPandas(task, "stem string").write.format("noop").mode("overwrite").save()


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """The converted documents so far."""
    return spark.read.schema(MARKDOWN + ", batch bigint").parquet(f"{root}/markdown")


def convert_batch(root: str, fetch: Fetch) -> Callable[[DataFrame, int], None]:
    """Convert the files of a batch of ingested events, but those that have markdown; good ones are published.

    What loops or is a stub is kept with its outcome and not published.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stem = F.regexp_replace(F.element_at(F.split("key", "/"), -1), r"[.][^.]*$", "")
        marks = Marks(root)
        new = marks.unmarked(batch.select("key", stem.alias("stem")).distinct(), number).select("key")
        rows = converted(fetch(new)).withColumn("stem", stem)
        rows = rows.select("stem", sharded_key("stem", "md", "markdown").alias("key"), F.col("key").alias("source_key"), "markdown", "total_pages", "outcome")
        path = f"{root}/markdown/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        good = spark.read.schema(MARKDOWN).parquet(path).where("outcome = 'ok'").withColumn("batch", F.lit(number))
        publish(good, f"{topic(root, CONVERTED_TOPIC)}/batch={number}", CONVERTED_TOPIC, _newest(batch), "key", "source_key", "batch")
        marks.mark(good, number)

    return run


def index_batch(root: str, embedder: Embedder | None = None, catalog: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Index the documents of a batch of converted events and publish each with its number of chunks."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        of = [r["batch"] for r in batch.select("batch").distinct().collect()]  # a row a batch of the step before
        held = markdown(spark, root) if None in of else markdown(spark, root).where(F.col("batch").isin(of))
        docs = held.join(batch.select("key").distinct(), "key", "left_semi").where("outcome = 'ok'")
        docs = docs.groupBy(F.col("stem").alias("doc_id")).agg(F.max_by("markdown", "batch").alias("text"), F.first("key").alias("key"))
        path = f"{root}/points/batch={number}"
        index_documents(docs, embedder, catalog=catalog).write.mode("overwrite").parquet(path)
        chunks = spark.read.parquet(path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
        rows = docs.select("doc_id", "key").join(chunks, "doc_id", "left").select("key", F.coalesce("chunks", F.lit(0)).alias("chunks_indexed"))
        publish(rows, f"{topic(root, INDEXED_TOPIC)}/batch={number}", INDEXED_TOPIC, _newest(batch), "key", "chunks_indexed")

    return run


def convert_stream(spark: SparkSession, root: str, fetch: Fetch, every: str | None = None) -> StreamingQuery:
    """Ingested events to markdown; `every` is a poll interval, without one the stream ends with what is there."""
    rows = without_repeats(parsed(events(spark, topic(root, INGESTED_TOPIC)), INGESTED_TOPIC))
    return run_to(rows, f"{root}/checkpoints/convert", convert_batch(root, fetch), every)


def index_stream(spark: SparkSession, root: str, embedder: Embedder | None = None, catalog: DataFrame | None = None, every: str | None = None) -> StreamingQuery:
    """Converted events to points."""
    rows = parsed(events(spark, topic(root, CONVERTED_TOPIC) + "/*"), CONVERTED_TOPIC, COMPLETED)
    return run_to(rows, f"{root}/checkpoints/index", index_batch(root, embedder, catalog), every)


class Progress(StreamingQueryListener):
    """The last progress reports of all streams, as JSON texts; add it to spark.streams."""

    def __init__(self, most: int = 1000):
        self.lines: deque[str] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.lines.append(event.progress.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
