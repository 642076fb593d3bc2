"""History of the catalog, counts of the pipeline and their drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.operators.catalog import file_parts


def history(catalog: DataFrame) -> DataFrame:
    """(activity, stem, name, detail, at): up to four events of each row; times are texts, as stored."""
    name = F.coalesce("title", "stem")
    pages = F.format_string("%dpg %.1fs", "conversion.total_pages", "conversion.duration_secs")
    failed = F.coalesce("conversion.failed", F.lit(False))
    converted = F.when(failed, F.concat(F.lit("FAILED: "), F.coalesce("conversion.reason", F.lit("unknown")), F.lit(" ("), pages, F.lit(")"))).otherwise(pages)
    event = lambda activity, detail, at, when: F.when(when, F.struct(F.lit(activity).alias("activity"), detail.alias("detail"), at.alias("at")))
    events = F.array_compact(
        F.array(
            event("Download", F.coalesce(F.col("file_size_bytes").cast("string"), F.lit("")), F.col("downloaded_at"), F.col("downloaded_at").isNotNull()),
            event("Convert", converted, F.col("conversion.converted_at"), F.col("conversion").isNotNull()),
            event("Embed", F.format_string("%d chunks", "embedding.chunks_indexed"), F.col("embedding.embedded_at"), F.col("embedding.chunks_indexed") > 0),
            event("EmbedSkip", F.col("embedding_skip.reason"), F.col("embedding_skip.at"), F.col("embedding_skip").isNotNull()),
        )
    )
    return catalog.select("stem", name.alias("name"), F.explode(events).alias("e")).select("e.activity", "stem", "name", "e.detail", "e.at")


def recent(catalog: DataFrame, limit: int = 30) -> DataFrame:
    """The newest events; ties by stem and activity."""
    return history(catalog).orderBy(F.desc("at"), "stem", "activity").limit(limit)


def file_counts(objects: DataFrame) -> DataFrame:
    """pdf, html, markdown and documents (pdf + html) of a listing."""
    n = lambda e: F.count_if(F.col("ext") == e)
    return file_parts(objects).agg(n("pdf").alias("pdf"), n("html").alias("html"), n("md").alias("markdown"), (n("pdf") + n("html")).alias("documents"))


def drift(documents: Column, markdown: Column, failed: Column, in_flight: Column) -> Column:
    """Documents that no stage accounts for; each subtraction stops at 0."""
    out = documents
    for x in (markdown, failed, in_flight):
        out = F.greatest(out - x, F.lit(0))
    return out


def share(part: Column, whole: Column) -> Column:
    """part / whole, at most 1, and 0 of nothing."""
    return F.least(F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)), F.lit(1.0))


def snapshot(catalog: DataFrame, objects: DataFrame, in_flight: int = 0) -> DataFrame:
    """One row of counts, drift and stage shares."""
    rows = catalog.agg(
        F.count_if(F.coalesce("conversion.failed", F.lit(False))).alias("failed"),
        F.count_if(F.coalesce(F.col("embedding.chunks_indexed") > 0, F.lit(False))).alias("embedded"),
        F.count(F.lit(1)).alias("catalog"),
    )
    both = file_counts(objects).join(rows)  # one row each
    return both.select(
        "*",
        drift(F.col("documents"), F.col("markdown"), F.col("failed"), F.lit(in_flight)).alias("drift"),
        share(F.col("failed"), F.col("documents")).alias("failed_share"),
        share(F.col("markdown"), F.col("documents") - F.col("failed")).alias("markdown_share"),
        share(F.col("embedded"), F.col("markdown")).alias("embedded_share"),
    )


def health(beats: DataFrame, now: Column, stale_seconds: int = 90, key: tuple[str, ...] = ("service_type", "url")) -> DataFrame:
    """The last beat of each service and whether it is younger than the limit."""
    last = beats.groupBy(*key).agg(F.max("at").alias("last_seen"))
    return last.withColumn("healthy", F.col("last_seen") > now - F.expr(f"interval {stale_seconds} seconds"))
