"""The ingest events as a stream: parsed, without repeats, converted, stamped once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholia.functions.html import html_to_markdown
from scholia.functions.repetition import cleaned
from scholia.functions.text import pages_of
from scholia.operators.quality import is_stub, qc_verdict
from scholia.schemas import EVENT_LINE, INGESTED

def events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """subject, payload, at from JSON lines that arrive in a folder."""
    return spark.readStream.schema(EVENT_LINE).option("maxFilesPerTrigger", max_files).json(path)


def parsed(lines: DataFrame, subject: str, schema: str = INGESTED) -> DataFrame:
    """The payloads of one subject; malformed ones and those without a key are dropped."""
    rows = lines.where(F.col("subject") == subject).select("at", F.from_json("payload", schema).alias("e"))
    return rows.where("e.key IS NOT NULL").select("at", "e.*")


def first_of_each(rows: DataFrame) -> DataFrame:
    """The first event of each key of a table."""
    return rows.groupBy("key").agg(F.min("at").alias("at"))


def without_repeats(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each key; state is kept for the watermark's time only."""
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["key"])


def converted(pages: DataFrame) -> DataFrame:
    """pages (key, html, duration) with markdown, sites, total_pages and outcome: ok, repetition_loop or stub."""
    rows = pages.withColumn("_md", html_to_markdown("html"))
    rows = rows.withColumn("_clean", F.explode(F.array(cleaned(F.col("_md")))))
    rows = rows.withColumns({"markdown": F.col("_clean.text"), "sites": F.col("_clean.sites")}).withColumn("total_pages", F.size(pages_of("markdown")))
    bad = qc_verdict(F.col("sites"), F.col("total_pages")) != "accept"
    outcome = F.when(bad, "repetition_loop").when(is_stub(F.col("total_pages"), F.col("markdown"), F.col("duration")), "stub").otherwise("ok")
    return rows.withColumn("outcome", outcome).drop("_md", "_clean")


def latest_state(rows: DataFrame, key: str = "key") -> DataFrame:
    """The newest event of each key and how many there were."""
    return rows.groupBy(key).agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n_events"))


def run_to(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Process what is there, batch by batch, and stop, or look again every so often, such as '30 seconds'.

    A batch that is repeated after a failure has the same number.
    """
    when = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**when).foreachBatch(write).start()
