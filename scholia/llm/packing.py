"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Bins are ordered by their residual.  Each carries a bitmap of the sources that are full
in it and one of the duplicate clusters that it holds.  A piece goes to the tightest bin
that fits and has no conflict: the search goes on from residual to larger residual until
one is found, and only then opens a new bin.  An AND of the bitmaps over ranges of
residuals lets the search pass over bins that all conflict.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.groups import map_groups
from scholia.llm.rows import column, placed_rows

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces of one source in a bin.
SOURCE_LIMIT = 4
#: Documents that are packed together.
SHARD_ROWS = 8192
#: Clusters of so many pieces of a shard take part in the search's bitmaps; smaller ones are tested bin by bin.
LARGE_CLUSTER = 32

WORD_SPLIT = r"[^\x20\x09-\x0D]+"


class Bins:
    """Open bins by residual, with the search for the tightest one without conflict."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        # masks of nothing are all ones: no bin there can take a piece
        self.tree = [-1] * (2 * self.size)
        self.by_mask: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.clusters: list[int] = []
        self.sources: list[Counter] = []

    def _refresh(self, residual: int) -> None:
        value = -1
        for mask in self.by_mask[residual]:
            value &= mask
        i = residual + self.size
        while i:
            if self.tree[i] == value and i < self.size:
                break
            self.tree[i] = value
            i >>= 1
            if i:
                value = self.tree[2 * i] & self.tree[2 * i + 1]

    def _next(self, low: int, bits: int) -> int:
        """The least residual from low on with a bin whose mask is free of the bits, or -1."""
        i = low + self.size
        while True:
            # some mask of the range lacks each bit; whether one lacks all shows at a single residual
            if not bits & self.tree[i]:
                if i < self.size:
                    i *= 2
                    continue
                if any(not bits & mask for mask in self.by_mask[i - self.size]):
                    return i - self.size
            while i & 1:
                i >>= 1
            if not i:
                return -1
            i += 1

    def place(self, length: int, bits: int, cluster: int) -> tuple[int, int, int] | None:
        """Take the tightest compatible bin out of the order: (bin, its mask, residual)."""
        low = length
        while low <= self.capacity and (r := self._next(low, bits)) >= 0:
            for mask, bins in self.by_mask[r].items():
                if bits & mask:
                    continue
                for at, b in enumerate(bins):
                    if not cluster & self.clusters[b]:
                        bins[at] = bins[-1]
                        bins.pop()
                        if not bins:
                            del self.by_mask[r][mask]
                            self._refresh(r)
                        return b, mask, r
            low = r + 1
        return None

    def put(self, b: int, mask: int, residual: int) -> None:
        bins = self.by_mask[residual].setdefault(mask, [])
        bins.append(b)
        if len(bins) == 1:
            self._refresh(residual)


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int, source_limit: int) -> list[int]:
    """The bin of each piece; pieces come in the order in which they are placed, none longer than the capacity."""
    members = Counter(c for c in clusters if c is not None)
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    large = {c: 1 << (len(source_bit) + k) for k, c in enumerate(c for c, n in members.items() if n >= LARGE_CLUSTER)}
    small = {c: 1 << k for k, c in enumerate(c for c, n in members.items() if 1 < n < LARGE_CLUSTER)}
    bins, out = Bins(capacity), []
    for length, source, cluster in zip(lengths, sources, clusters):
        bit, own = large.get(cluster, 0), small.get(cluster, 0)
        found = bins.place(length, source_bit[source] | bit, own)
        if found is None:
            b, mask, residual = len(bins.clusters), 0, capacity
            bins.clusters.append(0)
            bins.sources.append(Counter())
        else:
            b, mask, residual = found
        bins.clusters[b] |= own
        bins.sources[b][source] += 1
        if bins.sources[b][source] >= source_limit:
            mask |= source_bit[source]
        bins.put(b, mask | bit, residual - length)
        out.append(b)
    return out


def _pack(capacity: int, source_limit: int):
    def fn(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("doc_id").to_pylist()
        lengths = table.column("n").to_numpy()
        sources, clusters = table.column("source").to_pylist(), table.column("cluster").to_pylist()
        count = np.maximum(1, -(-lengths // capacity))
        row = np.repeat(np.arange(len(ids)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(capacity, lengths[row] - piece * capacity)
        # longest first; equal lengths by id, nulls first
        key = sorted(range(len(row)), key=lambda i: (-size[i], ids[row[i]] is not None, ids[row[i]] or 0, piece[i]))
        bins = best_fit([int(size[i]) for i in key], [sources[row[i]] for i in key], [clusters[row[i]] for i in key], capacity, source_limit)
        row, piece, size = row[key], piece[key], size[key]
        yield pa.RecordBatch.from_arrays(
            [
                table.column("shard").combine_chunks().take(pa.array(row)),
                pa.array(np.array(bins, np.int64)),
                pa.array([ids[i] for i in row], pa.int64()),
                pa.array(piece.astype(np.int64)),
                pa.array((piece * capacity).astype(np.int64)),
                pa.array(size.astype(np.int64)),
                pa.array([sources[i] for i in row], pa.string()),
                pa.array([clusters[i] for i in row], pa.int64()),
            ],
            names=["shard", "bin", "doc_id", "piece", "start", "length", "source", "cluster"],
        )

    return fn


def pack(docs: DataFrame, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, shard_rows: int = SHARD_ROWS, in_order: bool = False, cluster_col: str | None = None) -> DataFrame:
    """The bin of every piece: shard, bin, doc_id, piece, start, length, source, cluster.

    A document's length is its words and one end token.  One longer than the capacity is
    cut into pieces of the capacity and a rest, so nothing is lost.  A cluster is what
    cluster_col says, such as the class of a near-duplicate join; without it, the texts
    that agree but for case and white space.  No bin holds two pieces of a cluster, so none
    holds two pieces of one document, nor more than source_limit pieces of a source.

    Documents are packed in shards of about shard_rows: by a hash of their place in their
    files, so that equal rows are spread, or with in_order along the files, so that each
    shard keeps the mix of an ordered table.  Null texts have length 1, and without
    cluster_col no cluster; a null source is a source; rows without an id are packed with
    a null id; repeated rows are separate pieces of one cluster.  Other columns are
    ignored.  An empty table gives no bins.
    """
    own = ["doc_id", "text", "source", *([cluster_col] if cluster_col else [])]
    rows = placed_rows(docs.select(*map(column, own)))
    if in_order:
        shard = F.xxhash64("file", F.call_function("div", F.col("at"), F.lit(shard_rows)))
    else:
        shard = F.pmod("place", F.lit(max(1, -(-rows.count() // shard_rows))))
    text = F.col("row")["text"]
    if cluster_col:
        cluster = F.when(F.col("row")[cluster_col].isNotNull(), F.xxhash64(F.col("row")[cluster_col]))
    else:
        cluster = F.when(text.isNotNull(), F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))))
    items = rows.select(
        shard.alias("shard"),
        F.col("row")["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.regexp_count(text, F.lit(WORD_SPLIT)), F.lit(0)) + 1).cast("long").alias("n"),
        F.col("row")["source"].cast("string").alias("source"),
        cluster.alias("cluster"),
    )
    return map_groups(items, ["shard"], _pack(capacity, source_limit), "shard long, bin long, doc_id long, piece long, start long, length long, source string, cluster long")
