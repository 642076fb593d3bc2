"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

A source's documents are dealt into blocks, and each slot takes one block.  At a share w of
the slots, block i of a source is released at slot floor(i / w) and due before slot
ceil((i + 1) / w), and each slot takes the released block that is due first.  As the shares
sum to one, all blocks meet their deadlines, so a source is always less than one block off
its target.  Shares are whole parts, so releases and deadlines are exact.

The schedule is made in segments of slots that run in parallel (earliest_deadline.py).
Its work for a slot follows the segment's length; what goes on from segment to segment is
at most one block of each source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.earliest_deadline import earliest_deadline
from scholia.llm.rows import other_names, placed_rows
from scholia.llm.staging import staged

#: Weights are whole numbers of so many parts, as exact as doubles are.
PARTS = 1 << 52
#: Documents of a block.
BLOCK_ROWS = 8
#: Documents that are numbered together, a source's share of them at most.
BUCKET_ROWS = 1024

_NEW = ("source_pos", "block", "slot", "position")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def source_weights(counts: DataFrame, weights: Mapping[str, float] | None, exponent: float) -> DataFrame:
    """(key, n, tail, q): whole parts q for each source of counts (key, n).

    Given weights hold for the sources they name; sources without a weight come in the
    tail, after all others.  Without given weights, and in the tail, a source's weight is
    its number of documents to the power of the exponent.
    """
    own = F.pow(F.col("n").cast("double"), F.lit(exponent))
    if weights is None:
        rows = counts.withColumns({"tail": F.lit(False), "w": own})
    else:
        given = {k: float(w) for k, w in weights.items() if w > 0}
        pairs = F.array(*[F.struct(F.lit("1" + k).alias("key"), F.lit(w).alias("given")) for k, w in given.items()]) if given else F.array().cast("array<struct<key:string,given:double>>")
        table = counts.sparkSession.range(1).select(F.inline(pairs))
        rows = counts.join(table, "key", "left").withColumns({"tail": F.col("given").isNull(), "w": F.coalesce("given", own)})
    total = rows.groupBy("tail").agg(F.sum("w").alias("total"))  # two rows at most
    parts = F.greatest(F.lit(1), F.round(F.col("w") / F.col("total") * PARTS).cast("long"))
    return rows.join(F.broadcast(total), "tail").select("key", "n", "tail", parts.alias("q"))


def block_slots(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, block, slot) for every block (key, block) of the sources (key, n, tail, q)."""
    whole = sources.groupBy("tail").agg(F.count(F.lit(1)).alias("k"), F.sum("q").alias("of"))  # two rows at most
    most = whole.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    if not most:
        return blocks.withColumn("slot", F.lit(0).cast("long"))
    # the products pass 64 bits
    block, of, q = (F.col(c).cast("decimal(19,0)") for c in ("block", "of", "q"))
    release, deadline = _div(block * of, q), _div((block + 1) * of + q - 1, q)
    jobs = blocks.join(sources.select("key", "tail", "q").join(F.broadcast(whole), "tail"), "key")
    windows = jobs.select(F.col("tail").cast("long").alias("g"), F.col("key").alias("s"), F.col("block").alias("i"), release.cast("long").alias("r"), deadline.cast("long").alias("d"))
    slots = earliest_deadline(staged(windows, "windows"), most)
    slots = slots.select((F.col("g") == 1).alias("tail"), F.col("s").alias("key"), F.col("i").alias("block"), "slot")
    if not sources.where("tail").isEmpty():
        # what has no target comes when all others have ended
        slots = staged(slots, "slots")
        begin = slots.where("NOT tail").agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0]
        slots = slots.withColumn("slot", F.col("slot") + F.when(F.col("tail"), begin).otherwise(0))
    return slots.select("key", "block", "slot")


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    exponent: float = 0.5,
    block_rows: int = BLOCK_ROWS,
    source_col: str = "source",
) -> DataFrame:
    """All rows and columns of docs with source_pos, block, slot and position (long).

    Sorted by position the sources interleave at their weights: after any number of slots
    a source that still has documents is less than one block off its target, whatever the
    number of sources.  Every row has exactly one position; when a source ends its slots
    stay empty, so the others go on in their own proportions.  Within a source the order is
    that of a hash of the row's place in its file, so it is the same in each run over the
    same files, and equal rows and rows without an id are no hot group.

    With given weights, sources of no weight follow when all others have ended.  The work of
    a task follows a segment's slots, and what it holds the number of sources.  A null source is a source of its own,
    and one that is named in the weights but not in docs only leaves its share to the
    others.  An empty table gives an empty result.  Columns of the new names are replaced.
    """
    rows = placed_rows(docs, _NEW)
    source = F.col("row")[source_col].cast("string")
    key = F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))
    counts = staged(rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")), "sources")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a source's documents are numbered bucket by bucket, so no task gets a whole source
    bucket = F.pmod("place", F.lit(max(1, -(-total // BUCKET_ROWS)))).cast("int")
    ids = rows.select(key.alias("key"), bucket.alias("bucket"), "place", "at")
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ids.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("key", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "bucket").orderBy("place", "at")
    numbered = staged(ids.withColumn("k", F.row_number().over(inside)).join(starts, ["key", "bucket"]).select("key", "place", "at", (F.col("start") + F.col("k") - 1).alias("source_pos")), "numbered")
    blocks = numbered.where(F.pmod("source_pos", F.lit(block_rows)) == 0).select("key", _div(F.col("source_pos"), F.lit(block_rows)).alias("block"))
    slots = block_slots(blocks, staged(source_weights(counts, weights, exponent), "weights"))
    places = (
        numbered.withColumn("block", _div(F.col("source_pos"), F.lit(block_rows)))
        .join(slots, ["key", "block"])
        .select("place", "at", "source_pos", "block", "slot", (F.col("slot") * block_rows + F.pmod("source_pos", F.lit(block_rows))).alias("position"))
    )
    names = other_names(docs, _NEW)
    # merged at every size: the places grow with the documents
    return rows.join(places.hint("merge"), ["place", "at"]).select(*[F.col("row")[c].alias(c) for c in names], *_NEW)
