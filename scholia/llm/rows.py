"""Rows as one struct with their place in the files, so that no column name can clash and no two rows are one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.staging import staged


def column(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def other_names(docs: DataFrame, new: tuple[str, ...]) -> list[str]:
    """The columns that don't clash with new ones; names that differ in case alone are one name."""
    taken = {c.lower() for c in new}
    return [c for c in docs.columns if c.lower() not in taken]


def packed(docs: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """All columns but some as one struct."""
    names = other_names(docs, leave)
    return F.struct(*map(column, names)) if names else F.struct(F.lit(None).cast("int").alias("none"))


def straight_from_files(docs: DataFrame) -> bool:
    """Whether every row is a row of a file, with nothing done but filters and projections."""
    steps = docs._jdf.queryExecution().analyzed().treeString().splitlines()
    return all(x.lstrip(" +-:").split(" ")[0] in ("Project", "Filter", "Relation", "SubqueryAlias") for x in steps)


def placed_rows(docs: DataFrame, leave: tuple[str, ...] = ()) -> DataFrame:
    """(row, place, file, at): the row as a struct, a hash of its file and number there, a hash of the file, and the number.

    The place tells even equal rows apart, and a task that runs again finds it again.  A
    table that doesn't come straight from files is written first.
    """
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    where = [F.xxhash64(file, at).alias("place"), F.xxhash64(file).alias("file"), at.alias("at")]
    rows = docs.select(packed(docs, leave).alias("row"))
    if "_metadata" not in docs.columns and straight_from_files(docs):
        try:
            return docs.select(packed(docs, leave).alias("row"), *where)
        except AnalysisException:  # files of a kind without numbered rows
            pass
    return staged(rows, "rows").select("row", *where)
