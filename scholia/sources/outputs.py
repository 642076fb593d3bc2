"""Results as lines of text, for files and pipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import author_names


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row, null fields included, as the column value; write it as text."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def tab_lines(papers: DataFrame) -> DataFrame:
    """title, authors, date and DOI of papers between tabs; a missing date is empty, a missing DOI a dash."""
    parts = [F.coalesce("title", F.lit("")), author_names("authors"), F.coalesce(F.col("publication_date").cast("string"), F.lit("")), F.coalesce("doi", F.lit("-"))]
    return papers.select(F.concat_ws("\t", *parts).alias("value"))
