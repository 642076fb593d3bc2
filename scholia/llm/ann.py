"""Approximate nearest neighbours by cosine: few stable projections, kd-trees, chi-square stop.

Unit vectors are projected on M directions of Gaussian (2-stable) entries.  For a pair at
distance d the squared projected distance divided by d**2 is chi-square distributed with M
degrees of freedom.  So a search that takes points in the order of projected distance and
verifies them on the original vectors may stop once the next projected distance, squared,
exceeds the quantile times the squared distance of the k-th best: each better point is then
missed with a probability of at most 1 - SURE.

The upper levels of one kd-tree over the projections deal the vectors to cells; within a
cell's blocks a lower tree of small leaves gives the projected neighbours one after another.
A query first searches its own cell, and with the bound found there only the cells that the
test leaves open.  Queries travel to the blocks, and a block's vectors stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.staging import staged

#: Projected dimensions; even, for the closed form of the quantile.
M = 16
#: Probability with which a better point would have been met before the stop.
SURE = 0.92
#: Vectors, about, whose projections the upper tree is fitted on: so many a cell, and so many at least and at most.
CELL_SAMPLE, MIN_SAMPLE, MAX_SAMPLE = 8, 16384, 1 << 20
#: Vectors of a block, and points of a leaf.
BLOCK, LEAF = 8192, 32
#: Points that are verified between two tests.
STEP = 32


def chi_square_quantile(p: float, m: int = M) -> float:
    """The p-quantile for an even number m of degrees of freedom, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


def directions(dims: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, M))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component goes first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(1)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def projected(vectors: np.ndarray, dirs: np.ndarray) -> np.ndarray:
    return unit_rows(vectors) @ dirs


class UpperTree:
    """Median splits of a sample, as a heap: inner node i has children 2i+1 and 2i+2."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.dim = np.zeros(2**depth - 1, np.int64)
        self.cut = np.zeros(2**depth - 1)
        low, high = np.full((2**depth, M), -np.inf), np.full((2**depth, M), np.inf)
        self.low, self.high = low, high
        self._split(points, 0, np.full(M, -np.inf), np.full(M, np.inf))

    def _split(self, points: np.ndarray, i: int, low: np.ndarray, high: np.ndarray) -> None:
        if i >= len(self.dim):
            self.low[i - len(self.dim)], self.high[i - len(self.dim)] = low, high
            return
        d = int(points.var(0).argmax()) if len(points) else 0
        cut = float(np.median(points[:, d])) if len(points) else 0.0
        cut = min(max(cut, low[d]), high[d])
        self.dim[i], self.cut[i] = d, cut
        side = points[:, d] <= cut if len(points) else np.zeros(0, bool)
        a, b = high.copy(), low.copy()
        a[d] = b[d] = cut
        self._split(points[side], 2 * i + 1, low, a)
        self._split(points[~side], 2 * i + 2, b, high)

    def cell(self, points: np.ndarray) -> np.ndarray:
        i = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            i = 2 * i + 1 + (points[np.arange(len(points)), self.dim[i]] > self.cut[i])
        return i - len(self.dim)

    def squared(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell."""
        return box_squared(points, self.low, self.high)


def box_squared(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d])) ** 2
    return out


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Index arrays of a lower kd-tree's leaves: halves along the widest dimension."""
    todo, out = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        p = points[own]
        d = int((p.max(0) - p.min(0)).argmax())
        order = np.argpartition(p[:, d], len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Block:
    """The distinct vectors of a block below a kd-tree of small leaves."""

    def __init__(self, vectors: np.ndarray, dirs: np.ndarray):
        unit, self.dirs = unit_rows(vectors), dirs
        low = unit @ dirs
        parts = leaves(low)
        self.order = np.concatenate(parts)
        self.begin = np.cumsum([0] + [len(p) for p in parts])
        self.unit, self.low = unit[self.order], low[self.order]
        self.lows, self.highs = np.stack([low[p].min(0) for p in parts]), np.stack([low[p].max(0) for p in parts])
        self.verified = 0

    def near(self, ask: np.ndarray, bound: np.ndarray, k: int, quantile: float) -> Iterator[np.ndarray]:
        """For each query vector the points found, at least the k best of those met before the stop.

        bound is the squared distance of the k-th best point known from elsewhere.
        """
        unit = unit_rows(ask)
        low = unit @ self.dirs
        for q, p, far, box in zip(unit, low, bound.tolist(), box_squared(low, self.lows, self.highs)):
            yield self.order[self._one(q, p, far, box, k, quantile)]

    def _one(self, q: np.ndarray, p: np.ndarray, far: float, box: np.ndarray, k: int, quantile: float) -> np.ndarray:
        by_box = box.argsort()
        at, near, best, opened, width = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0, 4
        which = np.zeros(0, np.int64)
        while True:
            # leaves in the order of their distance; points nearer than the next leaf come now
            new = by_box[opened : opened + width]
            opened, width = opened + len(new), 2 * width
            new = new[box[new] <= quantile * far]
            if len(new):
                points = np.concatenate([np.arange(self.begin[x], self.begin[x + 1]) for x in new.tolist()])
                d = self.low[points] - p
                at, near = np.concatenate([at, points]), np.concatenate([near, np.einsum("ij,ij->i", d, d)])
            limit = box[by_box[opened]] if opened < len(by_box) else math.inf
            ready = near <= limit
            now = np.flatnonzero(ready)
            now = now[near[now].argsort()]
            for i in range(0, len(now), STEP):
                if near[now[i]] > quantile * far:
                    return which
                step = at[now[i : i + STEP]]
                self.verified += len(step)
                best, which = np.concatenate([best, self.unit[step] @ q]), np.concatenate([which, step])
                if len(best) > k:
                    keep = np.argpartition(-best, k - 1)[:k]
                    # all that tie with the last of them stay
                    keep = np.flatnonzero(best >= best[keep].min() - 1e-12)
                    best, which = best[keep], which[keep]
                if len(best) >= k:
                    far = min(far, max(0.0, 2 - 2 * float(best.min())))
            if limit > quantile * far or limit == math.inf:
                return which
            at, near = at[~ready], near[~ready]


def _search(k: int, dirs: np.ndarray, quantile: float):
    """Rows (qid, ids, score) of the points found, from rows sorted by cell, block and query.

    A block's vectors come before the queries, which stream past them batch by batch.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    yield batch.slice(i, 1024)

        here, held, block, data, ids = None, [], None, None, None
        for part in cut():
            table = pa.Table.from_batches([part])
            cell, number, asks = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("cell", "block", "query"))
            new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])]).tolist() + [len(cell)]
            for a, b in zip(new, new[1:]):
                rows = table.slice(a, b - a)
                if here != (cell[a], number[a]):
                    here, held, block = (cell[a], number[a]), [], None
                if not asks[a]:
                    held.append(rows.select(["vec", "ids"]))
                    continue
                if held:
                    whole = pa.concat_tables(held)
                    data, ids, held = _matrix(whole.column("vec")), whole.column("ids").combine_chunks(), []
                    block = Block(data, dirs)
                if block is None:
                    continue
                ask = _matrix(rows.column("vec"))
                found = list(block.near(ask, rows.column("bound").to_numpy().astype(float), k, quantile))
                q, row = np.repeat(np.arange(len(ask)), [len(f) for f in found]), np.concatenate(found)
                x, y = ask[q], data[row]
                x, y = x / np.abs(x).max(1)[:, None], y / np.abs(y).max(1)[:, None]
                score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield pa.RecordBatch.from_arrays([rows.column("qid").combine_chunks().take(pa.array(q)), ids.take(pa.array(row)), pa.array(score)], names=["qid", "ids", "score"])

    return task


def _best(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k best (key, vec_id, score), with their rank; a vec_id counts once, with its best score."""
    by = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return found.groupBy(key, "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, k: int = 5, sure: float = SURE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest vectors of each query: query_id, rank (from 1), vec_id, score.

    `is_query` is a condition on vectors; candidates are all rows but those with the
    query's id.  score is the cosine of the original vectors in double precision; ties go
    to the smaller id, and there are fewer than k rows only where there are fewer
    candidates.  Vectors that are null or zero, or hold null or non-finite components,
    take no part, nor do rows without an id, nor vectors of another length than most have
    (the longer one on a tie).  Equal vectors are searched as one with their k + 1
    smallest ids, and asked as one, which loses nothing.  Repeated rows count once, and an
    id with several vectors has the best score of them.  An empty table gives an empty
    result.

    The upper tree is fitted on the projections of a sample by a threshold on a hash, of
    CELL_SAMPLE vectors for each cell and MAX_SAMPLE at most; every vector is indexed.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    exact = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    v = v if exact else v.cast("array<double>")
    kind = "float" if exact else "double"
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
    shape = rows.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = shape
    rows = rows.where(F.size("vec") == dims)
    few = lambda x: F.slice(F.array_sort(F.array_distinct(x)), 1, k + 1)
    salted = rows.groupBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // BLOCK))).alias("salt")).agg(few(F.collect_set("vec_id")).alias("ids"), F.max("query").alias("query"))
    distinct = salted.groupBy("vec").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("query").alias("query"))
    dirs = directions(dims)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low = projected(_matrix(batch.column(0)), dirs).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(low[:, d]) for d in range(M)], names=[f"p{d}" for d in range(M)])

    depth = max(0, math.ceil(math.log2(n / BLOCK)))
    share = min(1.0, max(MIN_SAMPLE, min(MAX_SAMPLE, CELL_SAMPLE << depth)) / n)
    if depth:
        sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec")
        found = sample.mapInArrow(project, ", ".join(f"p{d} float" for d in range(M))).toArrow()
        points = np.stack([found.column(d).to_numpy() for d in range(M)], 1).astype(np.float64)
        depth = min(depth, int(math.log2(max(1.0, len(points) / CELL_SAMPLE))))
    else:
        points = np.zeros((0, M))
    tree = UpperTree(points, depth)
    shared = spark.sparkContext.broadcast(tree)
    quantile = chi_square_quantile(sure)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = shared.value.cell(projected(_matrix(batch.column(0)), dirs))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec", "ids", "query", "cell"])

    data = staged(distinct.mapInArrow(place, f"vec array<{kind}>, ids array<long>, query boolean, cell long"), "vectors")
    # a vector is named by its smallest id and its hash: one id may have several vectors
    asking = data.where("query").select(F.struct(F.get("ids", F.lit(0)).alias("id"), F.xxhash64("vec").alias("hash")).alias("qid"), "vec", "cell")
    blocks = data.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block_of = F.pmod(F.xxhash64("vec", F.lit(3)), F.col("blocks")).cast("int")
    none = F.lit(None)
    kept = data.join(F.broadcast(blocks), "cell").select("cell", block_of.alias("block"), F.lit(False).alias("query"), none.cast("struct<id:bigint,hash:bigint>").alias("qid"), "vec", "ids", none.cast("double").alias("bound"))

    def search(queries: DataFrame) -> DataFrame:
        sent = queries.join(F.broadcast(blocks), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("query"), "qid", "vec", none.cast("array<long>").alias("ids"), "bound")
        met = kept.union(sent).repartition("cell", "block").sortWithinPartitions("cell", "block", "query")
        found = met.mapInArrow(_search(k + 1, dirs, quantile), "qid struct<id:bigint,hash:bigint>, ids array<long>, score double")
        return staged(_best(found.select("qid", F.explode("ids").alias("vec_id"), "score"), "qid", k + 1).select("qid", "vec_id", "score"), "nearest")

    found = search(asking.withColumn("bound", F.lit(float("inf"))))
    if depth:
        kth = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") > k)
        bounded = asking.join(kth.select("qid", (2 - 2 * F.col("s")).alias("bound")), "qid", "left").select("vec", "qid", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

        def open_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, (1 << 20) >> depth)
            for whole in batches:
                for i in range(0, whole.num_rows, step):
                    batch = whole.slice(i, step)
                    far = shared.value.squared(projected(_matrix(batch.column(0)), dirs))
                    bound = batch.column(3).to_numpy(zero_copy_only=False)
                    own = batch.column(2).to_numpy(zero_copy_only=False)
                    go = far <= quantile * np.maximum(bound, 0)[:, None]
                    go[np.arange(len(own)), own] = False
                    q, cell = np.nonzero(go)
                    for j in range(0, len(q), 4096):
                        part = batch.take(pa.array(q[j : j + 4096]))
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell[j : j + 4096]), part.column(3)], names=["vec", "qid", "cell", "bound"])

        more = search(bounded.mapInArrow(open_cells, f"vec array<{kind}>, qid struct<id:bigint,hash:bigint>, cell long, bound double"))
        found = staged(_best(found.union(more), "qid", k + 1).select("qid", "vec_id", "score"), "nearest")
    # each query of a vector has the vector's neighbours but for itself
    who = rows.where("query").select(F.col("vec_id").alias("query_id"), "vec").distinct()
    named = who.join(asking.select("qid", "vec"), "vec").select("query_id", "qid")
    result = _best(named.join(found, "qid").where("query_id <> vec_id").select("query_id", "vec_id", "score"), "query_id", k)
    return result.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
