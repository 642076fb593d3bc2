"""Search over several sources: union, duplicates, merge, rank, filters, limit."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.dates import DateFilter
from scholia.functions.text import normalized_doi
from scholia.operators.dedup import dedup, doi_groups
from scholia.operators.merge import merge_groups, ranked
from scholia.plans.written import written

FLOOR = 0.3


def good_title(title):
    """More than ten bytes without the blanks around it."""
    return F.octet_length(F.regexp_replace(title, r"(?U)^\s+|\s+$", "")) > 10


def enough_citations(citations, least: int):
    """At least so many, or unknown."""
    return citations.isNull() | (citations >= least)


def metasearch(papers: DataFrame, query: str, limit: int = 20, dates: str | None = None, min_citations: int | None = None, by_citations: bool = False) -> DataFrame:
    """The best papers of the union of all sources, by blended score.

    Sorting by citations only drops papers of little relevance; the order stays the score's.
    """
    rows = papers.where(DateFilter.parse(dates).condition("publication_date")) if dates else papers
    best = ranked(merge_groups(dedup(rows, written)), query).where(good_title(F.col("title")))
    if min_citations is not None:
        best = best.where(enough_citations(F.col("cited_by_count"), min_citations))
    if by_citations:
        best = best.where(F.col("relevance") >= FLOOR)
    return best.orderBy(F.desc("score"), "id").limit(limit)


def ranked_by_place(results: DataFrame, place: str) -> DataFrame:
    """results with rank, their place in their source's answer from 0; place is the column that orders an answer."""
    by = Window.partitionBy("source").orderBy(place, "id")
    return results.withColumn("rank", F.row_number().over(by) - 1)


def all_sources(answers: Mapping[str, DataFrame | Exception]) -> tuple[DataFrame, DataFrame]:
    """The union of the answers of several sources, and a report (source, ok, error), a row for each.

    A source that failed is left out and told of in the report; if all did, it is a
    RuntimeError.  Columns that an answer lacks are null.
    """
    good = {name: a for name, a in answers.items() if isinstance(a, DataFrame)}
    if not good:
        raise RuntimeError("all sources failed: " + "; ".join(f"{name}: {a}" for name, a in answers.items()))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good.values())
    said = [(name, name in good, None if name in good else str(a)) for name, a in answers.items()]
    return rows, rows.sparkSession.createDataFrame(said, "source string, ok boolean, error string")


def by_doi(papers: DataFrame, doi: str) -> DataFrame:
    """The paper of an identifier, merged over all sources that know it; no row if none does.

    What arXiv has registered is looked for there alone.
    """
    prefix, key = "10.48550/arxiv.", doi.lower().removeprefix("https://doi.org/")
    rows = papers.where(normalized_doi("doi") == F.lit(key))
    rows = rows.where("source = 'arxiv'") if key.startswith(prefix) else rows
    return merge_groups(doi_groups(rows), "doi_key")


def downloadable(papers: DataFrame) -> DataFrame:
    """Papers with a url or an identifier."""
    return papers.where((F.size("download_urls") > 0) | F.col("doi").isNotNull())
