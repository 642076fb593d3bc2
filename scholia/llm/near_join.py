"""N-gram Jaccard join by chosen paths: near-duplicate documents on sets of five-word shingles.

The method follows the chosen-path similarity join (Christiani and Pagh).  A set is
placed below a tree node for each of a few *sampled tokens* that it has: the node
samples coordinates of the set's min-wise sketch, and the sets that agree on the
sampled shared token descend together.  Small buckets are compared by brute force,
large ones are split again on further sampled tokens, and the whole is run several
times, until the stated recall is reached.  Where splitting does not shrink a bucket,
its sets are alike, and it is compared in pairs of blocks, with no cap.

1. One pass makes a sketch and a set digest of each text; equal sets become one
   *representative* with a number of copies, so copies are never paired.
2. Runs of the tree give candidate links, at most one fewer than the sets of a
   bucket; later runs skip buckets whose sets are already connected.
3. Within each candidate component all pairs are verified exactly on the shingle sets,
   in pairs of blocks where it is large: a text goes to as many tasks as its component
   has blocks, which are 16 at most below 131072 sets and then follow the sets by the
   memory of a task.  Pairs are counted inside the task and only counts and a spanning
   forest leave it.
4. Connected components of the verified links are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.components import components
from scholia.llm.groups import local_roots, map_groups
from scholia.llm.staging import forget, staged
from scholia.llm.textvec import mix64, shingles, slices, text_buffer

#: Coordinates of the sketch.
SKETCH = 64
#: Sampled coordinates at each node, for which a pair of similarity s has 2 s common children on average.
FANOUT = 2
#: Sets of a bucket that is compared as it stands, and of a tile of a larger one.
BLOCK = 512
#: Blocks that an alike group of more than one block is cut into, and sets and shingles of a block of a very large one.
BLOCKS, BLOCK_SETS, BLOCK_SHINGLES = 16, 8192, 1 << 21
#: Levels of the tree.
DEPTH = 3
#: A child that keeps this share of its parent isn't split again.
DENSE = 0.6

_U = np.uint64
_SALTS = mix64(np.arange(1, SKETCH + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))


def runs_for(threshold: float, loss: float) -> int:
    """Runs of the tree after which a pair at the threshold was missed with the stated probability at most.

    A pair is lost below a node if it is lost in each sampled coordinate; q is the
    smallest fixed point of that recursion, the chance that one run of any depth loses it.
    """
    q = 0.0
    for _ in range(200):
        q = (1 - threshold + threshold * q) ** FANOUT
    return max(1, math.ceil(math.log(loss) / math.log(q))) if q > 0 else 1


def least_agreement(threshold: float, loss: float) -> int:
    """The most coordinates for which a pair at the threshold agrees on fewer with the stated probability at most."""
    below = 0.0
    for k in range(SKETCH):
        below += math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)
        if below > loss:
            return max(1, k)
    return SKETCH


def _sketch_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, hash) to (doc_id, hash, n, h1, h2, sketch)."""
    for batch in batches:
        for i, j in slices(batch.column(1)):
            texts = batch.column(1).slice(i, j - i)
            buf, off = text_buffer(texts)
            hashes, owner = shingles(buf, off)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            hashes, owner = hashes[new], owner[new]
            size = np.bincount(owner, minlength=j - i) if len(owner) else np.zeros(j - i, np.int64)
            some = np.flatnonzero(size)
            begin = np.concatenate([[0], np.cumsum(size[some])[:-1]]).astype(np.int64) if len(some) else np.zeros(0, np.int64)
            h1, h2 = np.zeros(j - i, _U), np.zeros(j - i, _U)
            sketch = np.zeros((j - i, SKETCH), np.int32)
            if len(some):
                h1[some] = np.add.reduceat(mix64(hashes), begin)
                h2[some] = np.add.reduceat(mix64(hashes ^ _SALTS[0]), begin)
                for k in range(SKETCH):
                    value = (hashes ^ _SALTS[k]) * (_SALTS[k] | _U(1))
                    low = np.minimum.reduceat(value ^ (value >> _U(29)), begin)
                    sketch[some, k] = (low >> _U(16)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i).cast(pa.int64()),
                    batch.column(2).slice(i, j - i),
                    pa.array(size.astype(np.int64)),
                    pa.array(h1.view(np.int64)),
                    pa.array(h2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * SKETCH + 1, SKETCH, dtype=np.int32)), pa.array(sketch.ravel())),
                ],
                names=["doc_id", "hash", "n", "h1", "h2", "sketch"],
            )


def _alike(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sketches agree on at least so many coordinates."""
    left, right = [], []
    step = max(1, (1 << 22) // max(1, b.size))
    for i in range(0, len(a), step):
        x, y = np.nonzero((a[i : i + step, None, :] == b[None, :, :]).sum(2) >= least)
        left.append(x + i)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def _bucket_links(least: int):
    """Candidate links of a bucket, or of a pair of blocks of one: a spanning forest."""

    def fn(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("id").to_numpy()
        if len(ids) < 2:
            return
        column = table.column("sketch").combine_chunks()
        sketch = column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), SKETCH)
        order = np.argsort(ids, kind="stable")
        ids, sketch = ids[order], sketch[order]
        a, b = _alike(sketch, sketch, least)
        up = a < b
        root = local_roots(len(ids), a[up], b[up])
        child = np.flatnonzero(root != np.arange(len(ids)))
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[child]]), pa.array(ids[child])], names=["a", "b"])

    return fn


def _blocks(m: Column, shingles: Column | None = None) -> Column:
    """Blocks of a group of m sets: of BLOCK sets, but at most BLOCKS, or more for the memory of a pair of blocks."""
    need = [F.least(F.ceil(m / F.lit(BLOCK)), F.lit(BLOCKS).cast("long")), F.ceil(m / F.lit(BLOCK_SETS))]
    return F.greatest(*need, *([F.ceil(shingles / F.lit(BLOCK_SHINGLES))] if shingles is not None else [])).cast("int")


def _in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Give each row of a group its pairs of blocks (lo, hi); one pair for a group of one block.

    A row is copied once for each block of its group.
    """
    rows = rows.withColumn("blocks", blocks)
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "*", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")
    )


def _tree_links(reps: DataFrame, run_ids: list[int], least: int) -> DataFrame:
    """Candidate links by the given runs of the tree over (id, comp, sketch)."""
    # no coordinate at two roots, so that the runs are independent
    order = np.random.default_rng(0).permutation(SKETCH // 2)
    picks = [int(order[(r * FANOUT + k) % len(order)]) for r in run_ids for k in range(FANOUT)]
    roots = F.array(*[F.xxhash64(F.lit(r), F.lit(picks[i * FANOUT + k]), F.col("sketch")[picks[i * FANOUT + k]]) for i, r in enumerate(run_ids) for k in range(FANOUT)])
    rows = reps.select("id", "comp", "sketch", F.explode(roots).alias("path"), F.lit(None).cast("long").alias("above"))
    found = None
    for depth in range(DEPTH):
        rows = staged(rows, "paths")
        count = (
            rows.groupBy("path")
            .agg(F.count(F.lit(1)).alias("m"), F.max("above").alias("parent"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
            .where("m > 1 AND c0 <> c1")
            .select("path", "m", "parent")
        )
        count = staged(count, "buckets")
        split = (F.col("m") > BLOCK) & (F.lit(depth < DEPTH - 1)) & (F.col("parent").isNull() | (F.col("m") < DENSE * F.col("parent")))
        # only the few rows of buckets that go on meet again; a hot path's rows are split by the adaptive join
        leaf = rows.join(count.where(~split).select("path", "m"), "path")
        links = staged(
            map_groups(_in_blocks(leaf, _blocks(F.col("m"))).select("path", "lo", "hi", "id", "sketch"), ["path", "lo", "hi"], _bucket_links(least), "a long, b long"), "found"
        )
        found = links if found is None else found.union(links)
        hot = count.where(split)
        if depth == DEPTH - 1 or hot.isEmpty():
            break
        # the node's own sampled coordinates, from the half that the roots don't use
        pick = [F.pmod(F.xxhash64("path", F.lit(k)), F.lit(SKETCH // 2)).cast("int") + SKETCH // 2 for k in range(FANOUT)]
        rows = rows.join(hot.select("path", "m"), "path").select(
            "id", "comp", "sketch", F.explode(F.array_distinct(F.array(*[F.xxhash64("path", p, F.element_at("sketch", p + 1)) for p in pick]))).alias("path"), F.col("m").alias("above")
        )
    return found


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts, sorted and distinct within each text, and the n + 1 places where texts begin."""
    found, size = [np.zeros(0, _U)], [np.zeros(1, np.int64)]
    for i, j in slices(texts):
        buf, off = text_buffer(texts.slice(i, j - i))
        h, o = shingles(buf, off)
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        found.append(h[new])
        size.append(np.bincount(o[new], minlength=j - i))
    return np.concatenate(found), np.cumsum(np.concatenate(size))


def _common(h: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The numbers of common shingles of the texts x with the texts y."""

    def taken(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = at[rows + 1] - at[rows]
        return h[np.repeat(at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(rows)), n)

    hx, ox = taken(x)
    hy, oy = taken(y)
    kx, cx = np.unique(hx, return_counts=True)
    ky, cy = np.unique(hy, return_counts=True)
    kinds, ix, iy = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
    everywhere = (cx[ix] == len(x)) & (cy[iy] == len(y))
    kinds = kinds[~everywhere]
    out = np.full((len(x), len(y)), everywhere.sum(), np.float32)
    if not len(kinds):
        return out

    def columns(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        token = np.minimum(np.searchsorted(kinds, values), len(kinds) - 1)
        keep = kinds[token] == values
        order = np.argsort(token[keep], kind="stable")
        return token[keep][order], owner[keep][order]

    tx, ox = columns(hx, ox)
    ty, oy = columns(hy, oy)
    width = max(64, (4 << 20) // max(len(x), len(y)))
    for c in range(0, len(kinds), width):
        w = min(width, len(kinds) - c)
        dense = []
        for token, owner, n in ((tx, ox, len(x)), (ty, oy, len(y))):
            a, b = np.searchsorted(token, [c, c + w])
            d = np.zeros((n, w), np.float32)
            d[owner[a:b], token[a:b] - c] = 1
            dense.append(d)
        out += dense[0] @ dense[1].T
    return out


def _exact(threshold: float):
    """Exact links of a candidate component, or of a pair of blocks of one, tile by tile.

    A row for each set with links: its id, the least id that it is connected to here, and
    the numbers of sets and of documents linked to it.  In a pair of two blocks only the
    pairs across count, in a single block all.
    """
    # |A n B| / (|A| + |B| - |A n B|) >= t, in whole numbers
    num, den = int(round(threshold * 1000)), 1000

    def fn(table: pa.Table) -> Iterator[pa.RecordBatch]:
        m = table.num_rows
        if m < 2:
            return
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        order = np.argsort(ids, kind="stable")  # a row's number is the rank of its id
        table = table.take(pa.array(order))
        ids, copies, mine = ids[order], copies[order], table.column("mine").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        h, at = _sets(table.column("text").combine_chunks())
        size = np.diff(at)
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        tiles = [(left[i : i + BLOCK], right[j : j + BLOCK], i == j and lo == hi) for i in range(0, len(left), BLOCK) for j in range(i if lo == hi else 0, len(right), BLOCK)]
        texts, docs = np.zeros(m, np.int64), np.zeros(m, np.int64)
        forest_a, forest_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y, same in tiles:
            link = _common(h, at, x, y).astype(np.int64) * (num + den) >= num * (size[x][:, None] + size[y][None, :])
            if same:
                np.fill_diagonal(link, False)
            a, b = np.nonzero(link)
            if not len(a):
                continue
            texts[x] += link.sum(1)
            docs[x] += link @ copies[y]
            if not same:
                texts[y] += link.sum(0)
                docs[y] += copies[x] @ link
            both = np.union1d(x, y)
            root = local_roots(len(both), np.searchsorted(both, x[a]), np.searchsorted(both, y[b]))
            child = np.flatnonzero(root != np.arange(len(both)))
            forest_a.append(both[root[child]])
            forest_b.append(both[child])
        some = np.flatnonzero(texts)
        if len(some):
            root = local_roots(m, np.concatenate(forest_a), np.concatenate(forest_b))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(texts[some]), pa.array(docs[some])], names=["a", "b", "texts", "docs"])

    return fn


def near_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class and the number of links of every document.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles
    is at least the threshold; a text of one to four words has one shingle, all its
    words.  Words are compared as they stand.  Returns one row for each input row:
    doc_id, class_id (the smallest id among connected documents; its own where there are
    none), n_copies (documents with the same shingle set, itself included), n_links
    (different sets linked to its own) and n_linked_docs (documents with those sets).

    Null or wordless texts have no shingles: they form classes of their own and are no
    copies of each other.  A row without an id gets a null class.  Rows with the same id
    count as copies if their texts agree; otherwise the class of the smaller class id
    holds.  Other columns are ignored.  An empty table gives an empty result.
    """
    # the tree and the test of sketches may each lose half of what the recall allows
    loss = (1 - recall) / 2
    least = least_agreement(threshold, loss)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    sig = staged(rows.mapInArrow(_sketch_rows, "doc_id long, hash long, n long, h1 long, h2 long, sketch array<int>"), "sketches")
    reps = staged(
        sig.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("n", "h1", "h2")
        .agg(F.min(F.struct("doc_id", "hash")).alias("of"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
        .select("n", "h1", "h2", F.col("of.doc_id").alias("id"), "of.hash", "copies", "sketch"),
        "sets",
    )
    total = runs_for(threshold, loss)
    links = _tree_links(reps.select("id", F.col("id").alias("comp"), "sketch"), [0], least)
    comps = components(links)
    if total > 1:
        again = reps.select("id", "sketch").join(comps, "id", "left").select("id", F.coalesce("root", "id").alias("comp"), "sketch")
        more = staged(_tree_links(again, list(range(1, total)), least), "more")
        if not more.isEmpty():
            comps = components(comps.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more))
    members = comps.join(reps.select("id", "hash", "n", "copies"), "id")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    members = staged(members.join(sizes, "root"), "members")
    # one row of each representative's text; a repeated id with another text has another set
    # (a merge join at every size: the members grow with the documents, and a broadcast would fit small inputs alone)
    texts = rows.join(members.withColumnRenamed("id", "doc_id").hint("merge"), ["doc_id", "hash"])
    texts = texts.groupBy("doc_id", "hash").agg(*[F.first(c).alias(c) for c in ("root", "m", "shingles", "copies", "text")]).withColumnRenamed("doc_id", "id")
    blocked = _in_blocks(texts, _blocks(F.col("m"), F.col("shingles"))).select("root", "lo", "hi", "mine", "id", "copies", "text")
    exact = staged(map_groups(blocked, ["root", "lo", "hi"], _exact(threshold), "a long, b long, texts long, docs long"), "links")
    classes = components(exact.select("a", "b"))
    counts = exact.groupBy(F.col("a").alias("id")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    by_set = staged(
        reps.select("n", "h1", "h2", "id", "copies").join(classes, "id", "left").join(counts, "id", "left").select("n", "h1", "h2", "copies", F.coalesce("root", "id").alias("root"), "texts", "docs"), "classes"
    )
    return (
        sig.select("doc_id", "n", "h1", "h2")
        .join(by_set, ["n", "h1", "h2"], "left")
        .select(
            "doc_id",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("class_id"),
            F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
            F.coalesce("texts", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("docs", F.lit(0)).cast("long").alias("n_linked_docs"),
        )
    )
