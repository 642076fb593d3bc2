"""Source divergence audit: which sources of a language use its terms differently, and which terms.

Every group (lang, source), and every lang, gives each kept term of the lang the smoothed
share p = 1 + floor(10^9 (count + 1) / (N + V)), and f = floor((p - q)^2 / q) says how far
a share p is from q.

Terms of a group against its lang.  f grows with p and falls with q below p.  A group's
terms are put into buckets by their count, and the largest count of a bucket with the
smallest count in the lang bounds f for all its terms.  Buckets are evaluated best bound
first until they hold k terms; their k-th value is reached by k terms, so of the unseen
buckets only those whose bound isn't strictly below it are evaluated as well.  That is two
passes over the postings, each of which reads the chosen buckets alone.

Groups against each other.  A term that neither of two groups has adds the same to their
sum whichever term it is, and one that only a has depends on its count in a alone.  So

    sum over all kept terms = V f(a0, b0)
        + sum over a's terms [f(a, b0) - f(a0, b0)] + sum over b's terms [f(a0, b) - f(a0, b0)]
        + sum over common terms [f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)]

with a0 and b0 the shares of a term that isn't there.  The first lines come from histograms
of the counts, the last from the postings, term by term, in tiles of TILE by TILE sources.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.staging import forget, staged

#: A term is kept in a lang if so many of its documents hold it.
MIN_DOCS = 3
#: Ranks of the terms of a group.
TOP = 200
#: Different terms that a task counts before it sends them on.
FLUSH = 1 << 19
#: What a document adds to a count of terms: far more than a task's terms.
_DOC = 1 << 40
#: Sources of a tile, postings that are compared at once, and parts that a tile's terms are dealt to.
TILE, CELLS, PARTS = 256, 1 << 20, 64

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of terms, and of documents that hold them."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a term's occurrences in the lower bits, and its documents above them
        held: dict[tuple[str, str], dict[str, int]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), seen in held.items():
                terms, both = pa.array(seen.keys(), pa.string()), np.fromiter(seen.values(), np.int64, len(seen))
                same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int64)))
                yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(both % _DOC), pa.array(both // _DOC)], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                terms = _TERM.findall(text.as_py().translate(_LOWER))
                if not terms:
                    continue
                seen = held.setdefault((langs[i], sources[i]), {})
                before, get = len(seen), seen.get
                for term, n in Counter(terms).items():
                    seen[term] = get(term, 0) + n + _DOC
                size += len(seen) - before
                if size >= FLUSH:
                    yield from rows()
                    size = 0
        yield from rows()

    return docs.mapInArrow(task, "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p, exactly: the product passes 64 bits."""
    return F.lit(1) + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), (total + kept).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _bucket(count: Column) -> Column:
    """Counts to 64 have a bucket each, larger ones eight for each doubling."""
    return F.when(count <= 64, count).otherwise(64 + F.floor((F.log2(count.cast("double")) - 6) * 8) + 1).cast("int")


def _top_terms(postings: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(lang, source, item, value, rank): each group's k terms with the largest f, best bounds first."""
    own, lang = _share(F.col("n"), F.col("total"), F.col("kept")), _share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))
    sizes = groups.select("lang", "source", "total", "total_lang", "kept")
    bounds = postings.groupBy("lang", "source", "bucket").agg(F.count(F.lit(1)).alias("terms"), F.max("n").alias("n"), F.min("n_lang").alias("n_lang"))
    bounds = bounds.join(sizes, ["lang", "source"]).withColumns({"p": own, "q": lang}).where("p > q").withColumn("bound", _f(F.col("p"), F.col("q")))
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
    before = F.coalesce(F.sum("terms").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = staged(bounds.select("lang", "source", "bucket", "bound", "total", "total_lang", "kept", (before < k).alias("first")), "buckets")

    def evaluated(buckets: DataFrame) -> DataFrame:
        chosen = postings.join(buckets.select("lang", "source", "bucket", "total", "total_lang", "kept"), ["lang", "source", "bucket"])
        shares = chosen.select("lang", "source", "term", own.alias("p"), lang.alias("q")).where("p > q")
        return shares.select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))

    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    seen = staged(top(evaluated(plan.where("first"))), "seen")
    kth = seen.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
    # a bucket whose bound is the k-th value may hold a tie with an earlier item
    more = plan.where("NOT first").join(kth, ["lang", "source"], "left").where("kth IS NULL OR bound >= kth")
    both = staged(top(seen.drop("rank").unionByName(evaluated(more))), "top-terms")
    for table in (plan, seen):
        forget(table)
    return both.select("lang", "source", "item", "value", "rank")


def _tiles(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Each row with column s once for each pair of tiles that its source is in, smaller tile first."""
    tile = F.call_function("div", F.col("s"), F.lit(TILE))
    last = other.select("lang", "tiles")
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct(F.least(t, tile).alias("i"), F.greatest(t, tile).alias("j"))))
    return rows.join(last, "lang").withColumn("pair", pairs).select("*", "pair.i", "pair.j").drop("pair", "tiles")


def _square(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): f summed over all kept terms, with a's shares against b's, for numbers a and b of sources of a lang.

    A task gets a pair of tiles, and of its terms one part in PARTS; the histograms and what
    no source has are a part of their own.  It sends on a number for each pair of sources.
    """
    tiles = groups.groupBy("lang").agg((F.call_function("div", F.max("s"), F.lit(TILE)) + 1).alias("tiles"))
    of = groups.select("lang", "source", "s", "total", "kept", "absent")
    p = _share(F.col("n"), F.col("total"), F.col("kept"))
    kind = lambda k: F.lit(k).alias("kind")
    none = F.lit("").alias("term")
    alone = _tiles(groups.where("kept > 0").select("lang", "s", kind(0), none, F.col("absent").alias("p"), "absent", F.col("kept").alias("times")), tiles)
    counted = postings.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")).join(of, ["lang", "source"])
    histogram = _tiles(counted.select("lang", "s", kind(1), none, p.alias("p"), "absent", "times"), tiles)
    present = postings.join(of, ["lang", "source"]).select("lang", "s", kind(2), "term", p.alias("p"), "absent", F.lit(1).cast("long").alias("times"))
    part = F.when(F.col("kind") == 2, F.pmod(F.xxhash64("term"), F.lit(PARTS))).otherwise(-1).cast("int")
    rows = alone.unionByName(histogram).unionByName(_tiles(present, tiles)).withColumn("part", part)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Tile(None)
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "i", "j", "part"))))
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "term", "s", "p", "absent", "times")]
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != state.key:
                    yield from state.sums()
                    state = _Tile(keys[at])
                state.add([c[at:end] for c in columns])
                at = end
        yield from state.sums()

    keyed = rows.repartition("lang", "i", "j", "part").sortWithinPartitions("lang", "i", "j", "part", "kind", "term", "s")
    sums = keyed.mapInArrow(task, "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


class _Tile:
    """The sums of one pair of tiles of sources, over the rows of one part."""

    def __init__(self, key: tuple | None):
        self.key = key
        self.rest: list[np.ndarray] | None = None
        if key is not None:
            _, self.i, self.j, _ = key
            self.width = TILE if self.i == self.j else 2 * TILE
            self.total = np.zeros((self.width, self.width), np.int64)
            self.absent = np.zeros(self.width, np.int64)

    def _place(self, s: np.ndarray) -> np.ndarray:
        """Where a source stands among those of the two tiles."""
        return np.where(s // TILE == self.i, s % TILE, TILE + s % TILE)

    def add(self, columns: list[np.ndarray]) -> None:
        kind = columns[0]
        self._alone([c[kind == 0] for c in columns])
        self._histogram([c[kind == 1] for c in columns])
        rows = [c[kind == 2] for c in columns]
        if self.rest is not None:
            rows = [np.concatenate(pair) for pair in zip(self.rest, rows)]
        # the last term's postings may go on in the next batch
        cut = int(np.searchsorted(rows[1], rows[1][-1])) if len(rows[1]) else 0
        self._common([c[:cut] for c in rows])
        self.rest = [c[cut:] for c in rows]

    def _alone(self, columns: list[np.ndarray]) -> None:
        _, _, s, p, _, times = columns
        if len(s):
            self.absent[self._place(s)] = p
            self.kept = int(times[0])

    def _histogram(self, columns: list[np.ndarray]) -> None:
        _, _, s, p, absent, times = columns
        if not len(s):
            return
        here = np.flatnonzero(self.absent)
        q = self.absent[here]
        for place, share, own, n in zip(self._place(s).tolist(), p, absent, times):
            self.total[place, here] += n * (_square(share, q) - _square(own, q))
            self.total[here, place] += n * (_square(q, share) - _square(q, own))

    def _common(self, columns: list[np.ndarray]) -> None:
        """Terms that several sources have, as many whole terms at once as fit into CELLS."""
        _, term, s, p, absent, _ = columns
        if not len(term):
            return
        place = self._place(s)
        begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        row = np.cumsum(np.concatenate([[0], (term[1:] != term[:-1]).astype(np.int64)]))
        step = max(1, CELLS // self.width)
        for first in range(0, len(begins), step):
            a = begins[first]
            b = begins[first + step] if first + step < len(begins) else len(term)
            used, column = np.unique(place[a:b], return_inverse=True)
            shares = np.zeros((min(step, len(begins) - first), len(used)), np.int64)
            shares[row[a:b] - first, column] = p[a:b]
            missing = np.zeros(len(used), np.int64)
            missing[column] = absent[a:b]
            for k in range(len(used)):
                have = shares[:, k] > 0
                mine, others = shares[have, k][:, None], shares[have]
                both = others > 0
                q = np.where(both, others, 1)
                value = _square(mine, q) - _square(mine, missing) - _square(missing[k], q) + _square(missing[k], missing)
                self.total[used[k], used] += np.where(both, value, 0).sum(0)

    def sums(self) -> Iterator[pa.RecordBatch]:
        if self.key is None:
            return
        if self.rest is not None:
            self._common(self.rest)
        here = np.flatnonzero(self.absent)
        if len(here):
            q = self.absent[here]
            self.total[np.ix_(here, here)] += self.kept * _square(q[:, None], q[None, :])
        a, b = np.nonzero(self.total)
        # a pair within one of two different tiles belongs to that tile's own pair
        mine = (a != b) & ((self.i == self.j) | ((a < TILE) != (b < TILE)))
        a, b = a[mine], b[mine]
        number = lambda x: np.where(x < TILE, self.i * TILE + x, self.j * TILE + x - TILE)
        lang = pa.array([self.key[0]], pa.string()).take(pa.array(np.zeros(len(a), np.int64)))
        yield pa.RecordBatch.from_arrays([lang, pa.array(number(a)), pa.array(number(b)), pa.array(self.total[a, b])], names=["lang", "a", "b", "value"])


def divergence(docs: DataFrame, k: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank.

    Part "pair" has for each group every other source of its lang, with f of the group's
    shares against the other's summed over the lang's kept terms, all ranks.  Part "term"
    has a group's terms whose share is above the lang's, with f against the lang's share, to
    rank k.  Larger values come first, and then items in the order of their UTF-8 bytes.

    Null text, lang and source are ''.  Repeated rows are documents of their own.  A lang
    without a kept term has pairs of value 0.  Other columns are ignored; an empty table
    gives an empty result.  Sums are exact 64-bit numbers, shares come from decimals.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    # dealt by the term alone, so that one shuffle serves the groups and the langs
    counts = _counts(rows).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    both = counts.withColumns({"n_lang": F.sum("n").over(of_term), "docs_lang": F.sum("docs").over(of_term)}).where(F.col("docs_lang") >= MIN_DOCS)
    postings = staged(both.select("lang", "source", "term", "n", "n_lang", _bucket(F.col("n")).alias("bucket")), "postings")

    total = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = postings.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("total_lang"))
    named = rows.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "kept", "total_lang"])
    absent = F.when(F.col("kept") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = staged(named.select("lang", "source", "total", "kept", "total_lang", absent.alias("absent"), numbered.alias("s")), "groups")

    terms = _top_terms(postings, groups, k).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    sums = staged(_pair_sums(postings, groups), "sums")
    one, other = groups.select("lang", "source", F.col("s").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("s").alias("b"))
    pairs = one.join(other, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms)
