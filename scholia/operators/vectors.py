"""Chunk vectors in Parquet: upsert, delete, facets and exact cosine top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.dates import year_condition


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def point_id(doc_id: Column, index: Column) -> Column:
    """A stable id of a chunk, of this library's own making: points of another writer have other ids."""
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), index.cast("string")), 256)


def top_k(points: DataFrame, query: Sequence[float], k: int, id_col: str, year: str | None = None, topic: str | None = None, where: Column | None = None, vector_col: str = "embedding") -> DataFrame:
    """The k points nearest to a query vector, after the filters; ties by id.

    A year filter that can't be read is ignored.  The plan is a scan with the filters
    pushed down and one TakeOrderedAndProject; no point is shuffled.
    """
    rows = points
    cond = year_condition(year, "year") if year is not None else None
    for c in (cond, F.array_contains("topics", topic) if topic is not None else None, where):
        if c is not None:
            rows = rows.where(c)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", cosine(F.col(vector_col), q)).where("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


def knn_by_group(points: DataFrame, query: Sequence[float], k: int, group: str, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """The k nearest of each group."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = Window.partitionBy(group).orderBy(F.desc("score"), id_col)
    return points.withColumn("score", cosine(F.col(vector_col), q)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def upsert(points: DataFrame, new: DataFrame, id_col: str = "point_id", doc_col: str = "doc_id") -> DataFrame:
    """points with every document of `new` replaced as a whole, so no chunk of an older, longer version stays."""
    latest = Window.partitionBy(id_col).orderBy(F.desc("indexed_at"))
    fresh = new.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
    return points.join(new.select(doc_col).distinct(), doc_col, "left_anti").unionByName(fresh)


def delete_docs(points: DataFrame, docs: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    return points.join(docs.select(doc_col).distinct(), doc_col, "left_anti")


def purge(points: DataFrame, stems: Sequence[str], doc_col: str = "doc_id") -> DataFrame:
    """points without the documents of a few stems."""
    return points.where(~F.col(doc_col).cast("string").isin(list(stems)) | F.col(doc_col).isNull())


def reindexed(points: DataFrame, new: DataFrame, docs: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """points with the documents of `docs` indexed anew: their old points go even where `new` has none for them."""
    return upsert(delete_docs(points, docs, doc_col), new, doc_col=doc_col) if "indexed_at" in new.columns else delete_docs(points, docs, doc_col).unionByName(new)


def partitioned_write(points: DataFrame, path: str, files_of: int = 1 << 20) -> None:
    """Write points as the table that searches read: one folder a year, sorted by document, of about so many rows a file.

    Year filters then skip folders, and filters by document skip row groups.
    """
    spread = points.repartitionByRange("year", "doc_id").sortWithinPartitions("year", "doc_id", "chunk_index")
    spread.write.option("maxRecordsPerFile", files_of).partitionBy("year").mode("overwrite").parquet(path)


def doc_facet(points: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Chunks of each document."""
    return points.groupBy(doc_col).agg(F.count(F.lit(1)).alias("n_chunks"))


def doc_count(points: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    return points.agg(F.count_distinct(doc_col).alias("n_docs"), F.count(F.lit(1)).alias("n_points"))
