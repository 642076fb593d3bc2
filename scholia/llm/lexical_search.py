"""Ranked lexical search over a two-level quantised index.

A document's score for an item sums w * impact over the item's terms, w being the term's
weight and impact = (10^9 tf) div (1000 tf + 8 m), at most 10^6.  The index has two levels,
a row of each for every document that holds a term that is asked for:

    level 1   the terms, and for each a byte, its impact in steps of STEP rounded upward
    level 2   the terms' counts tf and the document's norm m, from which scores are exact

A byte b says that the impact is above (b - 1) * STEP and at most b * STEP, so level 1 gives
each document a lower and an upper bound.  The k-th best lower bound of an item over all
documents is a score that k documents reach; every document whose upper bound reaches it
is scored again from level 2 in whole numbers, and the k best of those are the answer.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.staging import forget, staged

#: Impacts that one byte stands for: 245 * 4096 is above the largest, 10^6.
STEP = 4096
#: Terms of the items that are searched together, with repeats; a longer item is searched alone.
BLOCK_TERMS = 1 << 16
#: Cells of a task's matrix of documents and terms.
CELLS = 1 << 22

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, A-Z lower-cased."""
    return _TERM.findall(text.translate(_LOWER)) if text else []


@dataclass
class Items:
    """A block of items: item j has terms `ids[at[j]:at[j + 1]]`, each so many `times`."""

    names: list[int | None]
    vocabulary: dict[str, int]
    at: np.ndarray
    ids: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, list[str]]]) -> Items:
        vocabulary: dict[str, int] = {}
        at, ids, times = [0], [], []
        for _, terms in rows:
            own, n = np.unique(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms], np.int64), return_counts=True)
            ids.append(own)
            times.append(n)
            at.append(at[-1] + len(own))
        return cls([r[0] for r in rows], vocabulary, np.array(at), np.concatenate(ids), np.concatenate(times))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The different items that have terms, in blocks of bounded size, one of which is on the driver at a time."""
    rows, size = [], 0
    for row in items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).distinct().sort("id", "text").toLocalIterator():
        terms = terms_of(row.text)
        if not terms:
            continue
        if rows and size + len(terms) > BLOCK_TERMS:
            yield Items.of(rows)
            rows, size = [], 0
        rows.append((row.id, terms))
        size += len(terms)
    if rows:
        yield Items.of(rows)


def _counted(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, ids, tfs) of every document that has a term: n counts all its terms, ids and tfs are those of the items."""
    vocabulary = items.vocabulary

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            keep, lengths, ids, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                own, n = np.unique(np.array([k for k in map(get, terms) if k is not None], np.int32), return_counts=True)
                keep.append(i)
                lengths.append(len(terms))
                ids.append(own)
                tfs.append(n)
                ends.append(ends[-1] + len(own))
            whole = lambda parts, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), whole(ids, pa.int32()), whole(tfs, pa.int64())], names=["doc_id", "n", "ids", "tfs"]
            )

    return docs.mapInArrow(task, "doc_id long, n long, ids array<int>, tfs array<bigint>")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list of a column begins and ends, and all values one after another."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return ends, values


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The exact impact, in whole numbers."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _indexed(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, ids, bytes, tfs, m): both levels, for documents that hold a term of the items."""
    m = F.lit(25) + F.call_function("div", F.lit(75) * F.col("n") * F.lit(n_docs), F.lit(n_terms))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, tfs = _lists(batch.column("tfs"))
            own = np.repeat(batch.column("m").to_numpy(zero_copy_only=False), np.diff(ends))
            quantised = (-(-impacts(tfs, own) // STEP)).astype(np.uint8)
            offsets = pa.py_buffer(ends.astype(np.int32).tobytes())
            level1 = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(quantised.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), level1, batch.column("tfs"), batch.column("m")], names=["doc_id", "ids", "bytes", "tfs", "m"])

    rows = counted.where("size(ids) > 0").select("doc_id", "ids", "tfs", m.alias("m"))
    return rows.mapInArrow(task, "doc_id long, ids array<int>, bytes binary, tfs array<bigint>, m long")


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(16, CELLS // max(1, width))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _level1(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice of documents as a matrix (term, document), and where its lists end."""
    ends, ids = _lists(part.column("ids"))
    quantised = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8)
    matrix = np.zeros((width, part.num_rows))
    matrix[ids, np.repeat(np.arange(part.num_rows), np.diff(ends))] = quantised
    return matrix, ends


def _upper(matrix: np.ndarray, own: np.ndarray, weight: np.ndarray) -> np.ndarray:
    # sums of weights below 2^15, bytes and repeats: whole numbers far below 2^53, so doubles are exact
    return weight @ matrix[own]


def _lowest(index: DataFrame, items: Items, weights: np.ndarray, k: int) -> np.ndarray:
    """For each item the k-th largest lower bound over all documents, in steps; 0 if fewer than k documents hold a term."""
    width = len(items.vocabulary)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0)] * len(items.names)
        for batch in batches:
            for part in _slices(batch, width):
                matrix, _ = _level1(part, width)
                for j in range(len(best)):
                    own = items.ids[items.at[j] : items.at[j + 1]]
                    # an impact is above the step below its byte
                    low = _upper(np.maximum(matrix[own] - 1, 0), slice(None), weights[j])
                    low = low[low > 0]
                    if len(low) > k:
                        low = np.partition(low, -k)[-k:]
                    best[j] = np.concatenate([best[j], low])
                    if len(best[j]) > k:
                        best[j] = np.partition(best[j], -k)[-k:]
        item = np.repeat(np.arange(len(best)), [len(b) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(np.concatenate(best) if best else [], pa.float64())], names=["item", "low"])

    bounds = index.select("ids", "bytes").mapInArrow(task, "item int, low double")
    ranked = bounds.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low"))))
    out = np.zeros(len(items.names))
    for row in ranked.where(F.col("r") == k).select("item", "low").collect():  # a row an item of the block
        out[row["item"]] = row["low"]
    return out


def _rescored(index: DataFrame, items: Items, weights: list[np.ndarray], low: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best of the documents whose upper bound reaches the item's lower bound."""
    width = len(items.vocabulary)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items.names]
        for batch in batches:
            for part in _slices(batch, width):
                matrix, ends = _level1(part, width)
                tfs = part.column("tfs").flatten().to_numpy(zero_copy_only=False)
                ids = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                m = part.column("m").to_numpy(zero_copy_only=False)
                nameless = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                names = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                at = np.zeros(width, np.int64)
                for j, (score, name, none) in enumerate(best):
                    own = items.ids[items.at[j] : items.at[j + 1]]
                    upper = _upper(matrix, own, weights[j])
                    reach = np.flatnonzero((upper >= low[j]) & (upper > 0))
                    if not len(reach):
                        continue
                    at[own] = weights[j]
                    # the documents' lists one after another, and in them only the terms of this item
                    size = ends[reach + 1] - ends[reach]
                    of = np.repeat(np.arange(len(reach)), size)
                    places = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + ends[reach][of]
                    mine = at[ids[places]] > 0
                    of, places = of[mine], places[mine]
                    exact = np.zeros(len(reach), np.int64)
                    np.add.at(exact, of, at[ids[places]] * impacts(tfs[places], m[reach][of]))
                    at[own] = 0
                    some = exact > 0
                    score = np.concatenate([score, exact[some]])
                    name = np.concatenate([name, names[reach][some]])
                    none = np.concatenate([none, nameless[reach][some]])
                    first = np.lexsort((name, none, -score))[:k]
                    best[j] = score[first], name[first], none[first]
        item = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        score, name, none = (np.concatenate([b[i] for b in best]) if best else np.zeros(0) for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(name, pa.int64(), mask=none.astype(bool)), pa.array(score, pa.int64())], names=["item", "doc_id", "score"]
        )

    return index.mapInArrow(task, "item int, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each item, by score and then by smaller id.

    Only documents with a score above 0 are ranked, so there may be fewer than k.  Every row
    is a document of its own, so repeated rows rank one after another; rows without an id
    count in the statistics and rank after others of the same score.  Null and empty texts
    have no terms.  Equal items (id and text) are answered once, items of one id with
    different texts each with ranks of their own, and items without terms not at all.
    Other columns are ignored; an empty table gives an empty result.

    Items are searched in blocks of at most BLOCK_TERMS terms, each by a pass of its own over
    the documents, so the tasks' matrices don't grow with the number of items.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for block in item_blocks(items, item_col, item_text_col):
        counted = staged(_counted(rows, block), "counted")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            forget(counted)
            continue
        df = np.zeros(len(block.vocabulary), np.int64)
        # a row for each term of the block
        for term, n in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
            df[term] = n
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        weights = [w[block.ids[a:b]] * block.times[a:b] for a, b in zip(block.at, block.at[1:])]
        index = staged(_indexed(counted, n_docs, n_terms), "index")
        forget(counted)
        low = _lowest(index, block, [x.astype(float) for x in weights], k)
        best = _rescored(index, block, weights, low, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        names = spark.createDataFrame([(j, name) for j, name in enumerate(block.names)], "item int, item_id long")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(names), "item")
        ranked = staged(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
        forget(index)
        found = ranked if found is None else found.unionByName(ranked)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
