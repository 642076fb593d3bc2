"""Pages scored block by block: blocks of the truth are assigned to blocks that were found.

Pages whose whole texts nearly agree keep the score of their whole texts.  For the others,
of whatever size, found blocks are joined where only several of them make up a true one,
the cheapest assignment is made, pairs that hardly agree are taken apart again, and what is
left of the truth is looked for within the found blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.edits import edit_matrix, edits_of, matrices, window_edits
from scholia.operators.evaluate import normalized_text

#: Fixed value: whole texts this good need no blocks.
GOOD_PAGE = 97.0
#: No joining for a true block with a better single one; neighbours that are joined.
GOOD_PAIR, MOST_JOINED = 0.25, 5
#: Assigned pairs that are worse are apart; what is left needs a better one, by block or by window.
WORST_PAIR, WORST_REST, GOOD_REST, LEAST_WINDOW, GOOD_WINDOW = 0.7, 0.5, 0.3, 10, 0.1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and let `use` build an expression of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def assignment(costs: np.ndarray) -> list[int | None]:
    """For each row of a matrix its column, None for rows beyond the columns; the sum of costs is the least.

    Rows are brought in one after another, each along a shortest augmenting path under
    potentials.  Of equal ones the column with the smaller number comes first.
    """
    n, m = costs.shape
    if n > m:
        rows = assignment(costs.T)
        return [rows.index(i) if i in rows else None for i in range(n)]
    # rows and columns count from 1 here; 0 is the root of a path
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.intp)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        way, least, used = np.zeros(m + 1, np.intp), np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while at == 0 or owner[at]:
            used[at], own = True, owner[at]
            reduced = np.concatenate([[np.inf], costs[own - 1] - u[own] - v[1:]])
            nearer = ~used & (reduced < least)
            way[nearer], least[nearer] = at, reduced[nearer]
            at = int(np.argmin(np.where(used, np.inf, least)))
            near = least[at]
            u[owner[used]] += near
            v[used] -= near
            least[~used] -= near
        while at:
            owner[at], at = owner[way[at]], way[at]
    return [int(k) for k in np.argsort(owner[1:], kind="stable")[m - n :]]


def _matrix(costs: np.ndarray) -> np.ndarray:
    return np.array([list(row) for row in costs], float).reshape(len(costs), -1 if len(costs) else 0)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _assignments(costs: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else assignment(_matrix(c)) for c in costs], dtype=object)


def cheapest_assignment(costs: Column) -> Column:
    """array<int>: for each row of a matrix the number of its column, null for rows beyond the columns; the sum of costs is the least. A matrix without columns gives nulls."""
    return _assignments(costs)


#: Found blocks of a page up to which every set of them is looked at.
FEW_BLOCKS = 8


def cheapest_way(costs: list[list[float]]) -> list[int | None]:
    """For each row its column, by the least sum for every set of columns, added row by row as doubles.

    Of equal sums for a set the one whose last row has a column comes first, and of those the smaller column.
    """
    n, m = len(costs), len(costs[0])
    sets = {0: (0.0, ())}
    for i, row in enumerate(costs):
        following: dict[int, tuple[float, tuple]] = {}
        for j in [*range(m), None]:
            for used, (cost, way) in sets.items():
                if (i - used.bit_count() >= n - m) if j is None else used >> j & 1:
                    continue
                key, total = (used, cost) if j is None else (used | 1 << j, cost + row[j])
                if key not in following or total < following[key][0]:
                    following[key] = (total, (*way, j))
        sets = following
    return list(min((v for used, v in sets.items() if used.bit_count() == min(n, m)), key=lambda v: v[0])[1])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _cheapest_way(costs: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else cheapest_way([[float(x) for x in row] for row in c]) for c in costs], dtype=object)


def _texts(blocks: Column) -> Column:
    return F.filter(F.transform(F.coalesce(blocks, F.array().cast("array<string>")), normalized_text), lambda x: x != "")


def _shares(truth: Column, found: Column, edits: Column) -> Column:
    """The distances of a matrix over the longer lengths in bytes."""
    return F.zip_with(truth, edits, lambda a, row: F.zip_with(found, row, lambda b, n: n / F.greatest(F.octet_length(a), F.octet_length(b))))


def _runs(truth: list[str], found: list[str], costs: list[list[float]]) -> list[list[dict[int, int]]]:
    """For each found block and each longer run that begins with it, of up to five, the true blocks that the run may make up better than any block, with its end in the found text.

    A run holds no block that is the best of a true block and matches it well, and ends once
    it has twice the bytes of the true block.  Lengths that differ too much can't be better.
    """
    best = [min((x, j) for j, x in enumerate(row)) for row in costs]
    taken = {j for x, j in best if x < GOOD_PAIR}
    wanted = [(i, len(t), len(t.encode()), best[i][0]) for i, t in enumerate(truth) if best[i][0] >= GOOD_PAIR]
    chars, sizes, out = [len(x) for x in found], [len(x.encode()) for x in found], []
    for first in range(len(found)):
        runs, length, size = [], chars[first], sizes[first]
        for last in range(first + 1, min(first + MOST_JOINED, len(found))):
            if {first, last} & taken:
                break
            before, length, size = size, length + chars[last], size + sizes[last]
            open_ = [w for w in wanted if last == first + 1 or before <= 2 * w[2]]
            runs.append({i: length for i, n, s, ned in open_ if abs(n - length) < ned * max(s, size)})
        out.append(runs)
    return out


def _run_edits(pages: list[tuple[list[str], list[str], list]]) -> list[list[list[list[int | None]]]]:
    """For each page (truth, found, costs) and each of its found blocks the distances of the runs that begin with it to each true block that they may make up."""
    asks, places, out = [], [], [_runs(*page) for page in pages]
    for (truth, found, _), blocks in zip(pages, out):
        at, text = 0, "".join(found)
        for block, runs in zip(found, blocks):
            for i in sorted({i for run in runs for i in run}):
                some = [run for run in runs if i in run]
                asks.append((truth[i], text, at, [run[i] for run in some]))
                places.append((i, some))
            at += len(block)
    for (i, some), edits in zip(places, edits_of(asks)):
        for run, e in zip(some, edits):
            run[i] = e
    return [[[[run.get(i) for i in range(len(truth))] for run in runs] for runs in blocks] for (truth, _, _), blocks in zip(pages, out)]


_INTS = T.ArrayType(T.IntegerType())


@F.pandas_udf(T.StructType().add("edits", T.IntegerType()).add("matrix", T.ArrayType(_INTS)).add("runs", T.ArrayType(T.ArrayType(_INTS))))
def _page_edits(truth: pd.Series, found: pd.Series) -> pd.DataFrame:
    """A page's distance as one text, where that isn't good those of its blocks, and where they don't do those of runs; null where truth is."""
    pages = [None if t is None else (list(t), list(f)) for t, f in zip(truth, found)]
    some = [n for n, page in enumerate(pages) if page]
    texts = [["".join(blocks) for blocks in pages[n]] for n in some]
    out = pd.DataFrame({c: [None] * len(pages) for c in ("edits", "matrix", "runs")}, dtype=object)
    apart = []
    for n, (a, b), (edits,) in zip(some, texts, edits_of([(a, b, 0, [len(b)]) for a, b in texts])):
        out.at[n, "edits"] = edits
        if (1 - edits / max(len(a.encode()), len(b.encode()))) * 100 < GOOD_PAGE:
            apart.append(n)
    joins = []
    for n, matrix in zip(apart, matrices([pages[n] for n in apart])):
        out.at[n, "matrix"] = matrix
        sizes = [[len(x.encode()) for x in blocks] for blocks in pages[n]]
        costs = [[e / max(s, o) for e, o in zip(row, sizes[1])] for s, row in zip(sizes[0], matrix)]
        if any(min(row) >= GOOD_PAIR for row in costs):
            joins.append((n, (*pages[n], costs)))
    for (n, _), runs in zip(joins, _run_edits([page for _, page in joins])):
        out.at[n, "runs"] = runs
    return out


def _joined(truth: Column, found: Column, costs: Column, runs: Column) -> Column:
    """array<struct(first, last)>: the found blocks, those joined that together make up a true block better than any alone.

    A true block takes the best run of up to five neighbours, none of which is a good match
    of any true block; a run that grows beyond twice the true block ends there.  Of runs
    that overlap the one that begins first holds, and of those the earlier true block's.
    Without runs (null) every block stays alone.
    """
    m = F.size(found)
    bytes_of = lambda first, last: F.aggregate(F.slice(found, first + 1, last - first + 1), F.lit(0), lambda acc, x: acc + F.octet_length(x))

    def better(text: Column, least: Column, i: Column) -> Column:
        def of(ends: Column, first: Column) -> Column:
            sound = F.transform(
                ends,
                lambda edits, k: F.when(
                    (k == 0) | (bytes_of(first, first + k) <= 2 * F.octet_length(text)),
                    F.struct((F.get(edits, i) / F.greatest(F.octet_length(text), bytes_of(first, first + k + 1))).alias("ned"), first.alias("first"), (first + k + 1).alias("last")),
                ),
            )
            return F.filter(sound, lambda x: x["ned"] < least)

        return F.when(least >= GOOD_PAIR, F.array_min(F.flatten(F.transform(runs, of))))

    leasts = F.transform(costs, F.array_min)
    wanted = F.array_compact(F.transform(F.arrays_zip(truth.alias("text"), leasts.alias("least")), lambda x, i: better(x["text"], x["least"], i)))
    numbered = F.array_sort(F.transform(wanted, lambda x, i: F.struct(x["first"].alias("first"), i.alias("i"), x["last"].alias("last"))))
    none = F.array().cast("array<struct<first:int,last:int>>")
    held = F.aggregate(numbered, none, lambda acc, x: F.when(F.exists(acc, lambda y: (x["first"] <= y["last"]) & (y["first"] <= x["last"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["first"], x["last"])))))
    alone = lambda h: F.transform(F.filter(F.sequence(F.lit(0), m - 1), lambda j: ~F.exists(h, lambda y: j.between(y["first"], y["last"]))), lambda j: F.struct(j.alias("first"), j.alias("last")))
    every = F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.struct(j.alias("first"), j.alias("last")))
    return F.when(runs.isNotNull(), _let(held, lambda h: F.array_sort(F.concat(h, alone(h))))).otherwise(every)


def _bytes_before(block: str) -> np.ndarray:
    """The bytes before each place of a text, its end included."""
    points = np.frombuffer(block.encode("utf-32-le"), np.uint32)
    return np.cumsum(np.concatenate([[0], 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)]))


def window_share(text: str, found: list[str]) -> float | None:
    """The least distance of a text to windows of about its length within much longer found blocks; None without any.

    Windows have its length, 0.7 and 1.3 of it, and step by a fifth of it; one that nearly agrees ends its row.
    """
    size, out = len(text.encode()), None
    step = max(size // 5, 1)
    longer = [b for b in found if size >= LEAST_WINDOW and len(b) > len(text) * 3 // 2 and len(b.encode()) >= size // 2]
    widths = [sorted(w for w in {size, max(size * 7 // 10, 5), min(size * 13 // 10, len(b))} if w <= len(b)) for b in longer]
    for block, ws, rows in zip(longer, widths, window_edits(text, longer, step, widths) if longer else []):
        before = _bytes_before(block)
        for w, edits in zip(ws, rows):
            shares = edits / np.maximum(size, (before[w:] - before[:-w])[::step])
            good = np.flatnonzero(shares < GOOD_WINDOW)
            least = min(1.0, float(shares[: good[0] + 1 if len(good) else None].min()))
            out = least if out is None else min(out, least)
    return out


@F.pandas_udf(T.StructType().add("assigned", _INTS).add("windows", T.ArrayType(T.DoubleType())))
def _partners(truth: pd.Series, found: pd.Series, costs: pd.Series) -> pd.DataFrame:
    """The cheapest assignment without pairs that are worse than WORST_PAIR, and for each true block without a partner its least share of windows; null where costs are."""
    out = pd.DataFrame({c: [None] * len(truth) for c in ("assigned", "windows")}, dtype=object)
    for n, (t, f, c) in enumerate(zip(truth, found, costs)):
        if c is not None:
            matrix = _matrix(c)
            way = [None if j is None or matrix[i, j] > WORST_PAIR else j for i, j in enumerate(assignment(matrix))]
            out.at[n, "assigned"], out.at[n, "windows"] = way, [window_share(text, list(f)) if j is None else None for text, j in zip(t, way)]
    return out


# see edits.py: no projection takes them into a lambda
_page_edits, _partners, _cheapest_way, _assignments = (f.asNondeterministic() for f in (_page_edits, _partners, _cheapest_way, _assignments))


def _normalized(pages: DataFrame, ids: list[str], truth: str, found: str) -> DataFrame:
    """ids, _t and _f, the normalized blocks; through a generator, as a filter on them would work them out again."""
    return pages.select(*ids, F.inline(F.array(F.struct(_texts(F.col(truth)).alias("_t"), _texts(F.col(found)).alias("_f")))))


def assigned_blocks(pages: DataFrame, ids: list[str], truth: str = "truth", found: str = "found") -> DataFrame:
    """ids, i, j and ned of the pairs of the cheapest assignment that are kept: numbers from 0 of the normalized blocks that aren't empty.

    Of assignments that cost the same cheapest_way says which, for pages of few found blocks.

    truth and found are arrays of texts.  The whole assignment is made first, and pairs worse than WORST_PAIR are taken apart after it.
    """
    rows = _normalized(pages, ids, truth, found).where("size(_t) > 0 AND size(_f) > 0").withColumn("_edits", edit_matrix("_t", "_f"))
    rows = rows.withColumn("_costs", _shares(F.col("_t"), F.col("_f"), F.col("_edits")))
    few = F.size("_f") <= FEW_BLOCKS
    rows = rows.withColumns({"_few": _cheapest_way(F.when(few, F.col("_costs"))), "_many": cheapest_assignment(F.when(~few, F.col("_costs")))})
    pairs = rows.select(*ids, "_costs", F.posexplode(F.coalesce("_few", "_many")).alias("i", "j")).where("j IS NOT NULL")
    return pairs.select(*ids, "i", "j", F.get(F.get("_costs", F.col("i")), F.col("j")).alias("ned")).where(F.col("ned") <= WORST_PAIR)


def block_scores(pages: DataFrame, ids: list[str], truth: str = "truth", found: str = "found") -> DataFrame:
    """ids, whole and score, 0 to 100: a page's score as one text, and the better of that and the score by blocks.

    By blocks it is one less the share of edits in the lengths of all pairs, of the truth's
    blocks without a partner and of the found blocks without one.  A page without blocks on
    either side scores 100, and with blocks on one side alone 0.
    """
    t, f = F.col("_t"), F.col("_f")
    rows = _normalized(pages, ids, truth, found).withColumns({"_a": F.array_join("_t", ""), "_b": F.array_join("_f", "")})
    none = F.when((F.size(t) == 0) & (F.size(f) == 0), 100.0).when((F.size(t) == 0) | (F.size(f) == 0), 0.0)
    rows = rows.withColumn("_edits", _page_edits(F.when(none.isNull(), t), f))
    rows = rows.withColumns({"_matrix": F.col("_edits.matrix"), "_runs": F.col("_edits.runs")}).withColumn("_costs", _shares(t, f, F.col("_matrix")))
    rows = rows.withColumn("whole", F.coalesce(none, (1 - F.col("_edits.edits") / F.greatest(F.octet_length("_a"), F.octet_length("_b"))) * 100))
    rows = rows.withColumn("_spans", F.when(F.col("_costs").isNotNull(), _joined(t, f, F.col("_costs"), F.col("_runs"))))
    text_of = lambda s: F.array_join(F.slice(f, s["first"] + 1, s["last"] - s["first"] + 1), "")
    rows = rows.withColumn("_joins", F.filter("_spans", lambda s: s["first"] < s["last"])).withColumn("_blocks", F.transform("_spans", text_of))
    rows = rows.withColumn("_joined", edit_matrix(F.when(F.size("_joins") > 0, t), F.transform("_joins", text_of)))
    of_span = lambda i: lambda s: F.when(s["first"] == s["last"], F.get(F.get("_matrix", i), s["first"])).otherwise(F.get(F.get("_joined", i), F.array_position("_joins", s).cast("int") - 1))
    fitted = F.transform(F.when(F.col("_spans").isNotNull(), t), lambda _, i: F.transform("_spans", of_span(i)))
    rows = rows.withColumn("_matrix", fitted).withColumn("_costs", _shares(t, F.col("_blocks"), F.col("_matrix")))
    costs = F.col("_costs")
    rows = rows.withColumn("_partners", _partners(t, F.col("_blocks"), costs)).withColumns({c: F.col(f"_partners.{c[1:]}") for c in ("_assigned", "_windows")})
    scored = F.when(F.col("_spans").isNotNull(), _score(t, F.col("_blocks"), F.col("_matrix"), costs, F.col("_assigned"), F.col("_windows")))
    return rows.select(*ids, "whole", F.greatest("whole", scored).alias("score"))


def _score(truth: Column, blocks: Column, edits: Column, costs: Column, assigned: Column, windows: Column) -> Column:
    bytes_of = lambda x: F.octet_length(x).cast("long")

    def pair(i: Column, j: Column) -> Column:
        a, b = F.get(truth, i), F.get(blocks, j)
        return F.struct(F.get(F.get(edits, i), j).cast("long").alias("edits"), F.greatest(bytes_of(a), bytes_of(b)).alias("size"))

    def rest(acc: Column, x: Column) -> Column:
        """A true block without a partner takes the best found block that has none either, or a window, or counts in full."""
        i, text = x["i"], F.get(truth, x["i"])
        free = F.filter(F.transform(F.get(costs, i), lambda ned, j: F.struct(ned.alias("ned"), j.alias("j"))), lambda y: ~F.array_contains(acc["used"], y["j"]) & (y["ned"] < WORST_REST))

        def take(near: Column) -> Column:
            window = F.when(F.coalesce(near["ned"], F.lit(WORST_REST)) > GOOD_REST, F.get(windows, i))
            inside = window < F.coalesce(near["ned"], F.lit(WORST_REST))
            size = bytes_of(text)
            count = F.when(inside, F.struct(F.round(window * size).cast("long").alias("edits"), size.alias("size"))).when(near.isNotNull(), pair(i, near["j"])).otherwise(F.struct(size.alias("edits"), size.alias("size")))
            used = F.when(near.isNotNull() & ~F.coalesce(inside, F.lit(False)), F.concat(acc["used"], F.array(near["j"]))).otherwise(acc["used"])
            return _let(count, lambda c: F.struct((acc["edits"] + c["edits"]).alias("edits"), (acc["size"] + c["size"]).alias("size"), used.alias("used")))

        def known(c: Column) -> Column:
            return F.struct((acc["edits"] + c["edits"]).alias("edits"), (acc["size"] + c["size"]).alias("size"), acc["used"].alias("used"))

        return F.when(x["j"].isNotNull(), _let(pair(i, x["j"]), known)).otherwise(_let(F.array_min(free), take))

    def counted(pairs: Column) -> Column:
        rows = F.transform(pairs, lambda j, i: F.struct(i.alias("i"), j.alias("j")))
        start = F.struct(F.lit(0).cast("long").alias("edits"), F.lit(0).cast("long").alias("size"), F.array_compact(pairs).alias("used"))
        return _let(F.aggregate(rows, start, rest), whole)

    def whole(s: Column) -> Column:
        over = F.aggregate(F.filter(F.sequence(F.lit(0), F.size(blocks) - 1), lambda j: ~F.array_contains(s["used"], j)), F.lit(0).cast("long"), lambda acc, j: acc + bytes_of(F.get(blocks, j)))
        return F.when(s["size"] + over > 0, (1 - (s["edits"] + over) / (s["size"] + over)) * 100)

    return counted(assigned)
