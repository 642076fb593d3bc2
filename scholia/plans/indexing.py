"""Documents to indexed chunk vectors."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import first_year, sane_year, sharded_key
from scholia.operators.chunk import chunks
from scholia.operators.quality import with_quality
from scholia.operators.vectors import point_id, top_k

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dims: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed counts of hashed words, of unit length."""
    from zlib import crc32

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = crc32(w.encode())
                out[i, h % dims] += 1 if h & 0x10000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


#: Catalog columns that describe a document.
METADATA = ["title", "authors", "doi", "publication_date", "abstract_text", "cited_by_count", "source", "topics"]


def with_metadata(docs: DataFrame, catalog: DataFrame, id_col: str = "doc_id", text_col: str = "text", this_year: int | None = None) -> DataFrame:
    """docs with what the catalog says of their stem, pdf_path and year; a document that it doesn't know has nulls.

    A missing date is filled by the first year of the text's first 50 lines; a missing DOI
    is not, as the first one in a text is most often a reference's.  The path follows from
    the stem.  year is the date's, if it lies between 1900 and next year.
    """
    names = [c for c in METADATA if c in catalog.columns and c not in docs.columns]
    rows = docs.join(catalog.select(F.col("stem").alias("_stem"), *names), F.col(id_col).cast("string") == F.col("_stem"), "left").drop("_stem")
    day = F.col("publication_date").cast("string") if "publication_date" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("publication_date", F.coalesce(day, first_year(text_col))).withColumn("pdf_path", sharded_key(F.col(id_col).cast("string"), "pdf", "papers"))
    return rows.withColumn("year", sane_year("publication_date", this_year or date.today().year))


def index_documents(docs: DataFrame, embedder: Embedder | None = None, title_col: str | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """Points of all good chunks: point_id, doc_id, chunk_index, total_chunks, page, line_start, char_start, char_end, raw_text, embedding.

    The text that is embedded carries its header; chunks of low quality leave gaps in the
    index.  With a catalog the points also carry line_end and the metadata of its row (one
    for each stem), so that searches can filter by year and topic, and its title is the
    header's.
    """
    embed = embedder or hashing_embedder()
    meta = None
    if catalog is not None:
        named = with_metadata(docs, catalog)
        meta = named.select("doc_id", *[c for c in (*METADATA, "pdf_path", "year") if c in named.columns])
        if "title" in named.columns:
            docs, title_col = named, "title"

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed(texts.tolist())), index=texts.index)

    good = with_quality(chunks(docs, title_col=title_col), "raw_text").where("reject_reason IS NULL")
    own = ["doc_id", "chunk_index", "total_chunks", "page", "line_start", *(["line_end"] if meta is not None else []), "char_start", "char_end", "raw_text"]
    points = good.select(point_id(F.col("doc_id"), F.col("chunk_index")).alias("point_id"), *own, vectors("text").alias("embedding"))
    return points if meta is None else points.join(meta, "doc_id", "left")


def semantic_search(points: DataFrame, query: str, embedder: Embedder | None = None, limit: int = 10, year: str | None = None, topic: str | None = None) -> DataFrame:
    """The best hits of a text query: doc_id, title, authors, year, doi, chunk_text, score, pdf_path, line_start, line_end, page.

    The query is embedded as the chunks are; a blank one is a ValueError.  Filters that
    can't be read are ignored.  Points without a document or a text are no hits, and what a
    point doesn't carry is null.
    """
    if not query.strip():
        raise ValueError("the query is blank")
    vector = (embedder or hashing_embedder())([query])[0].tolist()
    rows = points.where("doc_id IS NOT NULL AND raw_text IS NOT NULL").withColumnRenamed("raw_text", "chunk_text")
    best = top_k(rows, vector, limit, "point_id", year=year, topic=topic)
    hit = {"title": "string", "authors": "array<string>", "year": "bigint", "doi": "string", "chunk_text": "string", "score": "double", "pdf_path": "string", "line_start": "int", "line_end": "int", "page": "int"}
    return best.select("doc_id", *[F.col(c) if c in best.columns else F.lit(None).cast(t).alias(c) for c, t in hit.items()])
