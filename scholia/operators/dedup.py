"""Duplicate papers: by identifier, then by fuzzy title, first match first."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.edits import edits_along
from scholia.functions.text import normalized_doi, normalized_title

#: How far each source is trusted.
SOURCE_WEIGHTS = {"semantic_scholar": 1.0, "openalex": 0.9, "arxiv": 0.8, "europe_pmc": 0.7, "crossref": 0.6}
OTHER_WEIGHT = 0.5
SIMILAR = 0.85
#: Texts of a part that one task compares with another part; hashed pairs of characters; texts of a product of matrices.
FREQUENT, GRAMS, CHUNK = 4096, 128, 256


def source_weight(source):
    """The weight of a source column."""
    out = F.lit(OTHER_WEIGHT)
    for name, w in SOURCE_WEIGHTS.items():
        out = F.when(source == name, F.lit(w)).otherwise(out)
    return out


def doi_groups(papers: DataFrame) -> DataFrame:
    """papers with doi_key and pos: the total order (trust, rank, id) in which they are looked at.

    pos is a struct, so that comparing it needs no global numbering.
    """
    return papers.withColumn("doi_key", normalized_doi("doi")).withColumn("pos", F.struct((-source_weight(F.col("source"))).alias("trust"), "rank", "id"))


def leaders(papers: DataFrame) -> DataFrame:
    """The first paper of each identifier group and of each distinct title without one.

    (key, title_key, pos, doi_first): texts that agree once normalised always share their
    group, so each is looked at once.  Identifier groups come before all others.
    """
    rows = doi_groups(papers).withColumn("title_key", normalized_title("title"))
    with_doi = rows.where("doi_key IS NOT NULL").groupBy(F.concat(F.lit("d:"), "doi_key").alias("key")).agg(F.min_by("title_key", "pos").alias("title_key"), F.min("pos").alias("pos"))
    without = rows.where("doi_key IS NULL").groupBy(F.concat(F.lit("t:"), "title_key").alias("key"), "title_key").agg(F.min("pos").alias("pos"))
    return with_doi.select("key", "title_key", F.struct(F.lit(0).alias("kind"), "pos").alias("at")).union(without.select("key", "title_key", F.struct(F.lit(1).alias("kind"), "pos").alias("at")))


def _counts(texts: list[str], q: int, size: int, longest: int) -> np.ndarray:
    """How often each text has the hashed grams of q characters."""
    out = np.zeros((len(texts), size), np.uint8 if longest < 256 else np.uint32)
    for row, text in zip(out, texts):
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        h = c if q == 1 else (c[:-1] * np.uint32(1000003) + c[1:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
        row += np.bincount(h % np.uint32(size), minlength=size).astype(out.dtype)
    return out


def _alike(a: list[str], b: list[str], least: float):
    """The pairs (a, b, similarity) of different texts of two lists that are similar.

    Texts k edits apart have all but k of the longer one's characters in common, and all but
    2 k of its pairs of neighbours.  Common pairs are first bounded by a product of
    matrices, with what a text has once or twice as bits; what has enough is counted, and
    what still has enough is compared.
    """
    a, b = sorted(a, key=len), sorted(b, key=len)
    na, nb = np.array([*map(len, a)]), np.array([*map(len, b)])
    longest = max(na[-1], nb[-1])
    most = np.floor(np.arange(longest + 1) * (1 - least) + 1e-9).astype(np.int64)
    share = np.arange(longest + 1) - 1 - 2 * most
    # the fewest that the longer text of this length or more must share
    fewest = np.minimum.accumulate(share[::-1])[::-1].astype(np.float32)
    (la, pa), (lb, pb) = ([_counts(x, q, size, longest) for q, size in ((1, 64), (2, 4 * GRAMS))] for x in (a, b))

    def bits(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        folded = pairs.reshape(len(pairs), 4, GRAMS).sum(axis=1, dtype=np.int64)
        return np.concatenate([folded >= 1, folded >= 2], axis=1).astype(np.float32), np.maximum(folded - 2, 0).sum(axis=1).astype(np.float32)

    (fa, xa), (fb, xb) = bits(pa), bits(pb)
    for at in range(0, len(a), CHUNK):
        some = slice(at, at + CHUNK)
        low, high = np.searchsorted(nb, na[some][0] * least - 1e-6), np.searchsorted(nb, na[some][-1] / least + 1e-6, "right")
        for begin in range(low, high, 4 * CHUNK):
            other = slice(begin, min(begin + 4 * CHUNK, high))
            common = fa[some] @ fb[other].T
            common += np.minimum(xa[some][:, None], xb[other][None, :])
            rows, columns = np.nonzero(common >= np.maximum(fewest[na[some]][:, None], fewest[nb[other]][None, :]))
            for k in range(0, len(rows), 16 * CHUNK):
                i, j = rows[k : k + 16 * CHUNK] + at, columns[k : k + 16 * CHUNK] + begin
                n = np.maximum(na[i], nb[j])
                for of_a, of_b, needed in ((la, lb, np.arange(longest + 1) - most), (pa, pb, share)):
                    fit = np.minimum(of_a[i], of_b[j]).sum(axis=1, dtype=np.int64) >= needed[n]
                    i, j, n = i[fit], j[fit], n[fit]
                for x, y, size in zip(i.tolist(), j.tolist(), n.tolist()):
                    if a[x] != b[y] and abs(len(a[x]) - len(b[y])) <= most[size]:
                        edits = edits_along([a[x]], b[y], [len(b[y])])[0][0]
                        if edits <= most[size] and (sim := 1 - edits / size) >= least:
                            yield a[x], b[y], sim


def candidate_titles(titles: DataFrame, least: float = SIMILAR, frequent: int = FREQUENT) -> DataFrame:
    """Pairs (a, b, sim) of different texts of titles (key, title_key, at) that are similar, b one of the kind without identifier.

    Each text is looked at once.  Texts go by their length into bands, of which only
    neighbours hold similar ones, and a band's into parts of about `frequent` texts.  A task
    has one part of either side, so it is bounded, and a text is sent as often as the bands
    next to its own have parts.

    Texts of fewer than six characters have no similar ones but their equals.
    """
    texts = titles.groupBy("title_key").agg(F.max(F.col("at.kind") == 1).alias("asks")).withColumn("n", F.length("title_key")).where("n >= 6")
    band = F.floor(F.log("n") / F.lit(-math.log(least))).cast("int")
    texts = texts.select("title_key", "asks", band.alias("band"))
    sizes = texts.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / frequent).cast("int").alias("a"), F.ceil(F.count_if("asks") / frequent).cast("int").alias("b"))
    near = sizes.select(F.col("band").alias("band_a"), F.col("a"), F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band_b"))
    pairs = near.join(sizes.select(F.col("band").alias("band_b"), "b"), "band_b").where("b > 0")
    part = lambda parts: F.pmod(F.xxhash64("title_key"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = texts.join(F.broadcast(pairs), F.col("band") == F.col("band_a")).select("band_a", "band_b", part(F.col("a")).alias("pa"), every("b").alias("pb"), F.lit(True).alias("left"), "title_key")
    right = texts.where("asks").join(F.broadcast(pairs), F.col("band") == F.col("band_b")).select("band_a", "band_b", every("a").alias("pa"), part(F.col("b")).alias("pb"), F.lit(False).alias("left"), "title_key")

    def alike(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group["title_key"][group["left"] == side].tolist() for side in (True, False))
        return pd.DataFrame(list(_alike(a, b, least)) if a and b else [], columns=["a", "b", "sim"]).astype({"a": object, "b": object, "sim": float})

    task = ["band_a", "band_b", "pa", "pb"]
    # few bytes, but much work: a number of partitions is kept, where small ones would be put together
    spark = titles.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return left.union(right).repartition(tasks, *task).groupBy(*task).applyInPandas(alike, "a string, b string, sim double")


def similar_titles(titles: DataFrame, least: float = SIMILAR, frequent: int = FREQUENT) -> DataFrame:
    """All pairs (a, b) of titles (key, title_key, at) that are similar, with b of the kind without identifier and a earlier; with at_a and sim."""
    pairs = candidate_titles(titles, least, frequent)
    left = titles.select(F.col("key").alias("a"), F.col("title_key").alias("ta"), F.col("at").alias("at_a"))
    right = titles.where("at.kind = 1").select(F.col("key").alias("b"), F.col("title_key").alias("tb"), F.col("at").alias("at_b"))
    close = pairs.select(F.col("a").alias("ta"), F.col("b").alias("tb"), "sim").join(right, "tb").join(left, "ta").where("at_a < at_b")
    same = titles.where("at.kind = 0").select(F.col("key").alias("a"), "title_key", F.col("at").alias("at_a"))
    equal = titles.where("at.kind = 1").select(F.col("key").alias("b"), "title_key").join(same, "title_key").select("a", "b", "at_a", F.lit(1.0).alias("sim"))
    return close.select("a", "b", "at_a", "sim").union(equal)


def first_of_each_text(titles: DataFrame) -> DataFrame:
    """titles without identifier, and of those with one the first of each text: no other leads a group of similar ones."""
    named = titles.where("at.kind = 0").groupBy("title_key").agg(F.min_by("key", "at").alias("key"), F.min("at").alias("at"))
    return named.select("key", "title_key", "at").union(titles.where("at.kind = 1").select("key", "title_key", "at"))


def greedy_groups(titles: DataFrame, pairs: DataFrame, cut) -> DataFrame:
    """(key, group_key, similarity): each title joins the first earlier leader that it resembles, else it leads.

    A title is decided once its earliest neighbour that isn't itself a follower is known
    to lead; each round decides all such titles at once.  `cut` writes a round's table
    and reads it back, which cuts the lineage.
    """
    pairs = cut(pairs)
    state = cut(titles.join(pairs.select(F.col("b").alias("key")).distinct().withColumn("open", F.lit(True)), "key", "left").select("key", F.when(F.col("open"), F.lit("?")).otherwise("L").alias("state"), F.lit(None).cast("string").alias("group_key"), F.lit(None).cast("double").alias("similarity")))
    while not state.where("state = '?'").isEmpty():
        live = pairs.join(state.select(F.col("key").alias("a"), F.col("state").alias("sa")), "a").where("sa <> 'F'")
        first = live.groupBy("b").agg(F.min_by(F.struct("a", "sa", "sim"), F.struct("at_a", "a")).alias("f"))
        step = state.join(first.withColumnRenamed("b", "key"), "key", "left")
        undecided = F.col("state") == "?"
        joins = undecided & (F.col("f.sa") == "L")
        state = cut(
            step.select(
                "key",
                F.when(joins, "F").when(undecided & F.col("f").isNull(), "L").otherwise(F.col("state")).alias("state"),
                F.when(joins, F.col("f.a")).otherwise(F.col("group_key")).alias("group_key"),
                F.when(joins, F.col("f.sim")).otherwise(F.col("similarity")).alias("similarity"),
            )
        )
    return state.select("key", F.coalesce("group_key", "key").alias("group_key"), "similarity")


def dedup(papers: DataFrame, cut) -> DataFrame:
    """papers with doi_key, pos, group_key and match_type: doi, fuzzy or none.

    Only papers without an identifier are matched by title, against the first paper of
    each group; matching is greedy and not transitive.
    """
    titles = cut(leaders(papers))
    groups = greedy_groups(titles.select("key"), similar_titles(first_of_each_text(titles)), cut)
    rows = doi_groups(papers).withColumn("key", F.when(F.col("doi_key").isNotNull(), F.concat(F.lit("d:"), "doi_key")).otherwise(F.concat(F.lit("t:"), normalized_title("title"))))
    first = titles.select("key", F.col("at.pos").alias("first_pos"))
    kind = F.when(F.col("pos") == F.col("first_pos"), F.when(F.col("key") == F.col("group_key"), "none").otherwise("fuzzy")).when(F.col("doi_key").isNotNull(), "doi").otherwise("fuzzy")
    return rows.join(groups.select("key", "group_key"), "key").join(first, "key").withColumn("match_type", kind).drop("first_pos", "key")


def dedup_stats(groups: DataFrame) -> DataFrame:
    """total_raw, unique, doi_matches and fuzzy_matches of dedup's rows."""
    return groups.agg(
        F.count(F.lit(1)).alias("total_raw"),
        F.count_distinct("group_key").alias("unique"),
        F.count_if(F.col("match_type") == "doi").alias("doi_matches"),
        F.count_if(F.col("match_type") == "fuzzy").alias("fuzzy_matches"),
    )
