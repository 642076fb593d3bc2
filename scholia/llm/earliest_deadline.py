"""Earliest deadline first for jobs of one slot, in parallel over segments of the slots.

Every job has a release and a deadline.  Each slot takes, of the jobs released and not
yet done, the one with the earliest deadline.  The slots are cut into segments, which
would have to wait for each other only because jobs are left over from one to the next.
What is left over follows from a short summary of each segment:

    a segment by itself does the jobs D of its own, leaves the jobs R and idles for some
    slots; if jobs S come in, all but |S| - idle of S and D together are done, and those
    with the latest deadlines go on, beside R.

That holds since jobs that come in are bound by nothing but the number of slots, so that
D with S is cut at the segment's length by deadline.  Two neighbouring segments have a
summary of the same form, so summaries are folded up a tree, the jobs that come in are
handed down it, and then each segment runs by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.staging import staged

#: Slots of a segment, and segments that are folded into one of the next level.
SEGMENT, FAN = 1024, 64

_JOBS = "array<struct<d:bigint,s:string,i:bigint>>"


def _let(value: Column, use) -> Column:
    """Evaluate `value` once and let `use` build an expression of it."""
    return F.transform(F.array(value), use)[0]


def _none(kind: str = _JOBS) -> Column:
    return F.array().cast(kind)


def _run(released: Column, begin: Column, end: Column, coming: Column) -> Column:
    """(left, done): the slots from begin to end, with the jobs released in the first SEGMENT of them and the jobs that come in.

    While jobs are released, only as many are kept in order as there are slots up to the end
    of the releases: of more jobs those with the latest deadlines can't have their turn
    there.  They wait aside, and come back for the slots behind.
    """
    turn = begin + SEGMENT
    groups = F.concat(F.array(F.struct(begin.alias("r"), coming.alias("new"))), released)
    steps = _let(groups, lambda g: F.transform(g, lambda x, k: F.struct(x["r"].alias("r"), F.coalesce(F.get(g, k + 1)["r"], turn).alias("next"), x["new"].alias("new"))))

    def named(jobs: Column, first: Column) -> Column:
        return F.transform(jobs, lambda job, k: F.struct((first + k).alias("slot"), job["d"].alias("d"), job["s"].alias("s"), job["i"].alias("i")))

    def step(acc: Column, x: Column) -> Column:
        def take(open_: Column) -> Column:
            n = F.least(F.size(open_).cast("long"), x["next"] - x["r"]).cast("int")
            room = (turn - x["next"]).cast("int")
            return F.struct(
                F.slice(open_, n + 1, room).alias("left"),
                F.concat(acc["aside"], F.slice(open_, n + room + 1, F.size(open_))).alias("aside"),
                F.concat(acc["done"], named(F.slice(open_, 1, n), x["r"])).alias("done"),
            )

        return _let(F.sort_array(F.concat(acc["left"], x["new"])), take)

    def behind(acc: Column) -> Column:
        def take(open_: Column) -> Column:
            n = F.least(F.size(open_).cast("long"), end - turn).cast("int")
            return F.struct(F.slice(open_, n + 1, F.size(open_)).alias("left"), F.concat(acc["done"], named(F.slice(open_, 1, n), turn)).alias("done"))

        return _let(F.sort_array(F.concat(acc["left"], acc["aside"])), take)

    start = F.struct(_none().alias("left"), _none().alias("aside"), _none("array<struct<slot:bigint,d:bigint,s:string,i:bigint>>").alias("done"))
    return F.aggregate(steps, start, step, behind)


def _then(acc: Column, x: Column, most: int) -> Column:
    """The summary (idle, late, left) of a run of segments followed by one more."""
    over = F.greatest(F.lit(0).cast("long"), F.size(acc["left"]) - x["idle"])
    return _let(
        F.struct(F.sort_array(F.concat(acc["left"], x["late"]), False).alias("pool"), over.cast("int").alias("over")),
        lambda p: F.struct(
            (acc["idle"] + x["idle"] - F.size(acc["left"]) + p["over"]).alias("idle"),
            F.slice(F.sort_array(F.concat(acc["late"], F.slice(p["pool"], p["over"] + 1, F.size(p["pool"]))), False), 1, most).alias("late"),
            F.concat(x["left"], F.slice(p["pool"], 1, p["over"])).alias("left"),
        ),
    )


def _nothing() -> Column:
    return F.struct(F.lit(0).cast("long").alias("idle"), _none().alias("late"), _none().alias("left"))


def earliest_deadline(jobs: DataFrame, sources: int) -> DataFrame:
    """(g, s, i, slot) for jobs (g, s, i, r, d) of each group g by itself.

    s and i name a job in its group; r is its release and d its deadline, exclusive.  There
    are no more than `sources` jobs open at a time in a group, which bounds the arrays.  A
    segment without a release is part of the one before, so there are no more segments than
    jobs, however far apart these are.
    """
    segment = F.call_function("div", F.col("r"), F.lit(SEGMENT))
    at = jobs.withColumn("seg", segment)
    released = at.groupBy("g", "seg", "r").agg(F.collect_list(F.struct("d", "s", "i")).alias("new"))
    released = released.groupBy("g", "seg").agg(F.sort_array(F.collect_list(F.struct("r", "new"))).alias("released"))
    # a narrow row a segment
    in_order = Window.partitionBy("g").orderBy("seg")
    lengths = at.select("g", "seg").distinct().select("g", "seg", (F.row_number().over(in_order) - 1).cast("long").alias("k"), F.lead("seg").over(in_order).alias("next"))
    begin = F.col("seg") * SEGMENT
    ends = F.coalesce(F.col("next") * SEGMENT, begin + SEGMENT + sources)
    segments = staged(released.join(lengths, ["g", "seg"]).select("g", "k", begin.alias("begin"), ends.alias("end"), "released"), "segments")
    begin, end = F.col("begin"), F.col("end")

    alone = segments.select("g", "k", begin, end, _run(F.col("released"), begin, end, _none()).alias("run"))
    late = F.slice(F.sort_array(F.transform("run.done", lambda x: F.struct(x["d"].alias("d"), x["s"].alias("s"), x["i"].alias("i"))), False), 1, sources)
    nodes = alone.select("g", "k", (end - begin - F.size("run.done")).alias("idle"), late.alias("late"), F.col("run.left").alias("left"))

    # up: each level's nodes in groups of FAN neighbours, until one group is left
    levels = []
    count = segments.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0] + 1
    while True:
        up = F.call_function("div", F.col("k"), F.lit(FAN))
        groups = staged(nodes.groupBy("g", up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("k", "idle", "late", "left"))).alias("below")), "summaries")
        levels.append(groups)
        count = -(-count // FAN)
        if count <= 1:
            break
        folded = groups.select("g", F.col("up").alias("k"), F.aggregate("below", _nothing(), lambda acc, x: _then(acc, x, sources)).alias("sum"))
        nodes = folded.select("g", "k", "sum.idle", "sum.late", "sum.left")

    # down: what comes into a group goes on through its nodes
    coming = None
    for groups in reversed(levels):
        into = groups.withColumn("left", _none()) if coming is None else groups.join(coming.select("g", F.col("k").alias("up"), "left"), ["g", "up"])
        start = F.struct(F.struct(F.lit(0).cast("long").alias("idle"), _none().alias("late"), F.col("left").alias("left")).alias("sum"), _none(f"array<struct<k:bigint,left:{_JOBS}>>").alias("into"))

        def hand(acc: Column, x: Column) -> Column:
            return F.struct(_then(acc["sum"], x, 0).alias("sum"), F.concat(acc["into"], F.array(F.struct(x["k"].alias("k"), acc["sum"]["left"].alias("left")))).alias("into"))

        coming = into.select("g", F.explode(F.aggregate("below", start, hand)["into"]).alias("x")).select("g", "x.k", "x.left")

    done = segments.join(coming, ["g", "k"]).select("g", F.explode(_run(F.col("released"), begin, end, F.col("left"))["done"]).alias("x"))
    return done.select("g", "x.s", "x.i", "x.slot")
