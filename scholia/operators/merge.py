"""One paper of each group, field by field, and its rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import relevance
from scholia.operators.dedup import source_weight

RRF_K = 60


def merge_groups(rows: DataFrame, group: str = "group_key") -> DataFrame:
    """One row for each group.

    The id is the first paper's; title and abstract the longest in bytes and the authors
    the most, the last of equals; date and identifier the first known; urls the ordered
    distinct union; citations the maximum; sources sorted and joined by '+'.  rrf is the
    sum of weight / (60 + rank + 1).
    """
    longest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.octet_length(c), "pos")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    urls = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("download_urls", F.array().cast("array<string>")).alias("urls"))))
    return rows.groupBy(group).agg(
        F.min_by("id", "pos").alias("id"),
        longest("title").alias("title"),
        F.max_by("authors", F.struct(F.size("authors"), "pos")).alias("authors"),
        longest("abstract_text").alias("abstract_text"),
        first("publication_date").alias("publication_date"),
        first("doi").alias("doi"),
        F.array_distinct(F.flatten(F.transform(urls, lambda x: x["urls"]))).alias("download_urls"),
        F.max("cited_by_count").alias("cited_by_count"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"),
        F.sum(source_weight(F.col("source")) / (RRF_K + F.col("rank") + 1)).alias("rrf"),
        F.count(F.lit(1)).alias("n_papers"),
    )


def blended(rrf: Column, relevance: Column, citations: Column) -> Column:
    """0.4 rank fusion + 0.35 relevance + 0.25 log citations."""
    return F.lit(0.4) * rrf + F.lit(0.35) * relevance + F.lit(0.25) * F.log1p(F.coalesce(citations, F.lit(0)).cast("double")) / F.log(F.lit(10001.0))


def ranked(merged: DataFrame, query: str) -> DataFrame:
    """merged with relevance and score; sort by score descending, then id."""
    rel = relevance(query, "title", "abstract_text", "doi", "publication_date")
    return merged.withColumn("relevance", rel).withColumn("score", blended(F.col("rrf"), F.col("relevance"), F.col("cited_by_count")))
