"""Registered queries of the point table and of semantic search, each with its SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.plans.indexing import semantic_search
from scholia.plans.oracle import _Q0
from scholia.plans.queries import _first_vector, _r, query
from scholia.plans.views import table
from scholia.plans.written import folder
from scholia.sources.point_table import PointTable

POINTS: dict[str, str] = {}


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks, three of a document."""
    i = F.col("vec_id")
    doc = F.concat(F.lit("d"), F.call_function("div", i, F.lit(3)).cast("string"))
    return table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL").select(
        F.concat_ws(":", doc, (i % 3).cast("string")).alias("point_id"), doc.alias("doc_id"), (i % 3).cast("int").alias("chunk_index"), F.lit(1).cast("long").alias("indexed_at"),
        (2000 + i % 20).alias("year"), F.concat(F.lit("text "), i.cast("string")).alias("raw_text"), "embedding", "vec_id",
    )


@query
def points_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point table after every seventh document came again with one chunk less and every eleventh was taken out."""
    points = _points(spark, sf_dir)
    store = PointTable(spark, f"{folder(spark)}/points/{uuid.uuid4().hex}", 32)
    store.upsert(points)
    number = F.substring("doc_id", 2, 20).cast("long")
    store.upsert(points.where((number % 7 == 0) & (F.col("chunk_index") < 2)).withColumn("indexed_at", F.lit(2).cast("long")))
    store.delete(points.where(number % 11 == 0).select("doc_id").distinct())
    return store.points().select("doc_id", "chunk_index", "indexed_at", "vec_id")


POINTS["points_upsert"] = """WITH p AS (SELECT vec_id, vec_id // 3 AS d, CAST(vec_id % 3 AS INTEGER) AS c FROM embeddings WHERE vec_id IS NOT NULL)
SELECT 'd' || d AS doc_id, c AS chunk_index, CAST(CASE WHEN d % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS indexed_at, vec_id FROM p WHERE d % 11 <> 0 AND NOT (d % 7 = 0 AND c = 2
  AND EXISTS (SELECT 1 FROM p o WHERE o.d = p.d AND o.c < 2))"""


@query
def semantic_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text query through the embedder's seam, among the points of some years."""
    first = np.array([_first_vector(spark, sf_dir)])
    hits = semantic_search(_points(spark, sf_dir), "the first vector", lambda texts: np.repeat(first, len(texts), 0), 15, year=">=2010")
    return hits.select("doc_id", "chunk_text", "year", _r(F.col("score"), "score"))


POINTS["semantic_hits"] = f"""SELECT 'd' || (vec_id // 3) AS doc_id, 'text ' || vec_id AS chunk_text, 2000 + vec_id % 20 AS year, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS score
FROM embeddings e, {_Q0} WHERE vec_id % 20 >= 10 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.v) DESC, 'd' || (vec_id // 3) || ':' || (vec_id % 3) LIMIT 15"""
