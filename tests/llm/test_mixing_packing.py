import random
from collections import Counter, defaultdict

import pytest

from scholia.llm import earliest_deadline as E
from scholia.llm.mixing import mix
from scholia.llm.packing import best_fit, pack
from scholia.llm.rows import straight_from_files
from tests.llm.helpers import words


def test_mixing_keeps_all_rows_within_a_block(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a"] * 6 + ["b"] * 3 + ["c"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mix(df, weights, block_rows=4).collect()
    assert sorted(x.doc_id for x in got) == list(range(3000))
    assert len({x.position for x in got}) == 3000
    blocks = {(x.source, x.block): x.slot for x in got}
    assert len(set(blocks.values())) == len(blocks)
    # until the first source ends, every prefix of slots is within one block of the weights
    end = min(max(s for (src, _), s in blocks.items() if src == k) for k in weights)
    at = {s: src for (src, _), s in blocks.items()}
    seen = Counter()
    for t in range(end):
        seen[at[t]] += 1
        for k, w in weights.items():
            assert abs(seen[k] - (t + 1) * w) < 1, (t, k)


def test_mixing_follows_unrounded_weights(spark):
    # one source of target weight 0.0005 among alike ones: no rounding to a short period, at any length
    weights = {"a": 0.4995, "b": 0.3, "c": 0.2, "d": 0.0005}
    sizes = {k: int(w * 40000) for k, w in weights.items()}
    ids = spark.createDataFrame([(k, n) for k, n in sizes.items()], "source string, n int").selectExpr("source", "explode(sequence(1, n)) AS k")
    got = mix(ids.selectExpr("source", "xxhash64(source, k) AS doc_id"), weights, block_rows=1).select("source", "slot").collect()
    worst = deviation([(r.source, r.slot) for r in got], weights)
    assert worst < 1
    # default weights are the roots of the counts
    sizes = {"p": 9000, "q": 2500, "r": 1600, "s": 30}
    ids = spark.createDataFrame([(k, n) for k, n in sizes.items()], "source string, n int").selectExpr("source", "explode(sequence(1, n)) AS k")
    got = mix(ids.selectExpr("source", "xxhash64(source, k) AS doc_id"), block_rows=1).select("source", "slot").collect()
    roots = {k: n**0.5 for k, n in sizes.items()}
    worst = deviation([(r.source, r.slot) for r in got], {k: w / sum(roots.values()) for k, w in roots.items()})
    assert worst < 1


def deviation(blocks, weights):
    """The largest distance from the target over all prefixes until the first source ends."""
    at = {slot: source for source, slot in blocks}
    assert len(at) == len(blocks)
    end = min(max(s for k, s in blocks if k == key) for key in weights)
    seen, worst = Counter(), 0
    for t in range(end):
        seen[at[t]] += 1
        worst = max(worst, *(abs(seen[k] - (t + 1) * w) for k, w in weights.items()))
    return worst


def test_mixing_puts_sources_without_weight_last(spark):
    rows = [(i, "abc"[i % 3]) for i in range(60)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 0.7, "b": 0.3}, block_rows=2).collect()
    assert len({r.position for r in got}) == 60
    assert min(r.slot for r in got if r.source == "c") > max(r.slot for r in got if r.source != "c")


def plain_deadlines(jobs):
    """Slots of jobs (name, release, deadline), slot by slot."""
    todo, open_, out, t = sorted(jobs, key=lambda j: j[1]), [], {}, 0
    while todo or open_:
        while todo and todo[0][1] <= t:
            open_.append(todo.pop(0))
        if open_:
            job = min(open_, key=lambda j: (j[2], j[0]))
            open_.remove(job)
            out[job[0]] = t
        t = t + 1 if open_ or not todo else max(t + 1, todo[0][1])
    return out


@pytest.mark.parametrize(("segment", "fan"), [(4, 2), (16, 3), (1024, 64)])
def test_segments_give_the_schedule_of_a_run_slot_by_slot(spark, monkeypatch, segment, fan):
    monkeypatch.setattr(E, "SEGMENT", segment)
    monkeypatch.setattr(E, "FAN", fan)
    r = random.Random(segment)
    rows, sources = [], 0
    for g in range(6):
        q = [r.choice([1, 1, 2, 3, 7, 40, 100]) for _ in range(r.randint(1, 9))]
        of, sources = sum(q), max(sources, len(q))
        # some sources end early, so that slots stay empty
        rows += [(g, f"s{k}", i, i * of // w, -(-(i + 1) * of // w)) for k, w in enumerate(q) for i in range(r.randint(1, max(1, 150 * w // of)))]
    jobs = spark.createDataFrame(rows, "g long, s string, i long, r long, d long")
    got = {(x.g, x.s, x.i): x.slot for x in E.earliest_deadline(jobs, sources).collect()}
    want = {}
    for g in range(6):
        own = plain_deadlines([((s, i), a, b) for k, s, i, a, b in rows if k == g])
        want |= {(g, *name): slot for name, slot in own.items()}
    assert got == want
    assert all(a <= got[g, s, i] < b for g, s, i, a, b in rows)


def test_mixing_takes_any_number_of_sources(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('host', id % 1500) AS source")
    got = mix(df, block_rows=1).select("doc_id", "position").collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    assert len({r.position for r in got}) == 4000


@pytest.mark.parametrize("n", [1100, 20_000])
def test_many_sources_stay_within_a_block(spark, n):
    # a few heavy sources among many light ones, at the default weights and segments
    df = spark.range(n).selectExpr("concat('s', id) AS source", "CASE WHEN id < 5 THEN 20 * (id + 2) ELSE 1 + id % 3 END AS n")
    blocks = df.selectExpr("source", "n", "explode(sequence(1, n)) AS doc_id")
    got = mix(blocks, block_rows=1).select("source", "slot", "n").toPandas()
    sizes = got.groupby("source").n.first()
    w = sizes**0.5 / (sizes**0.5).sum()
    assert got.slot.is_unique and len(got) == sizes.sum()
    # a source's k-th block leaves it k off before it and k + 1 after it
    own = got.sort_values("slot")
    k, share = own.groupby("source").cumcount(), own.source.map(w)
    assert (abs(k - own.slot * share) < 1).all() and (abs(k + 1 - (own.slot + 1) * share) < 1).all()


def test_small_weights_do_not_drift(spark):
    weights = {"a": 0.9996, "b": 0.0004}
    df = spark.createDataFrame([("a", 12000), ("b", 40)], "source string, n int").selectExpr("source", "explode(sequence(1, n)) AS doc_id")
    got = mix(df, weights, block_rows=1).select("source", "slot").collect()
    seen = {"a": 0, "b": 0}
    for t, s in enumerate(s for _, s in sorted((r.slot, r.source) for r in got if r.slot < 12000)):
        seen[s] += 1
        assert abs(seen["b"] - (t + 1) * 0.0004) < 1


def test_equal_rows_are_no_hot_group(spark):
    df = spark.createDataFrame([(None, "s")] * 300 + [(i, "s") for i in range(20)], "doc_id long, source string")
    got = mix(df, block_rows=4).collect()
    assert len(got) == 320 and len({r.position for r in got}) == 320 and {r.source_pos for r in got} == set(range(320))
    shards = Counter(r.shard for r in pack(df.selectExpr("doc_id", "CAST(NULL AS string) AS text", "source"), shard_rows=40).collect())
    assert max(shards.values()) < 100


def test_mixing_edges(spark):
    assert mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0
    rows = [(1, None), (2, None), (2, None), (None, "x"), (3, "x"), (4, "")]
    names = ["slot", "_n", "_k", "k", "period", "_key", "_hash", "_bucket", "_i", "key", "place", "at", "row", "n"]
    got = mix(spark.createDataFrame([(*x, *range(len(names))) for x in rows], "doc_id long, source string, " + ", ".join(f"{x} int" for x in names))).collect()
    assert Counter((x.doc_id, x.source) for x in got) == Counter(rows)
    assert all(r[x] == i for r in got for i, x in enumerate(names) if x != "slot")
    assert len({x.position for x in got}) == len(rows)


def test_rows_that_come_from_one_row_of_a_file_stay_apart(spark, tmp_path):
    spark.createDataFrame([(i, f"s{i % 3}") for i in range(50)], "doc_id long, source string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert straight_from_files(docs.where("doc_id > 3").select("source", "doc_id"))
    twice = docs.selectExpr("doc_id", "source", "explode(array(1, 1)) AS x")
    joined = docs.join(docs.groupBy("source").count(), "source")
    for rows, n in ((docs, 50), (twice, 100), (joined, 50), (docs.union(docs), 100)):
        got = mix(rows, block_rows=2).collect()
        assert len(got) == n == len({r.position for r in got})
        assert len(pack(rows.selectExpr("doc_id", "source", "'a b' AS text"), shard_rows=16).collect()) == n


def test_mixing_is_native(spark):
    plan = mix(spark.createDataFrame([(1, "a")], "doc_id long, source string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_best_fit_takes_the_tightest_bin():
    """Every step against all bins: of those with room and without conflict the fullest is taken, and a new one only if there is none."""
    r = random.Random(3)
    for trial in range(60):
        n, kinds = r.randint(1, 160), r.choice([1, 3, 8, 40])
        lengths = sorted((r.randint(1, 60) for _ in range(n)), reverse=True)
        sources = [r.choice("aaab") for _ in range(n)]
        clusters = [r.choice([None, *range(kinds)]) for _ in range(n)]
        members = Counter(c for c in clusters if c is not None)
        got = best_fit(lengths, sources, clusters, 64, 2)
        bins = {}
        for b, k, s, c in zip(got, lengths, sources, clusters):
            ok = [x["left"] for x in bins.values() if x["left"] >= k and x["src"][s] < 2 and not (members[c] > 1 and c in x["cl"])]
            if b in bins:
                assert bins[b]["left"] == min(ok) and bins[b]["src"][s] < 2 and not (c is not None and members[c] > 1 and c in bins[b]["cl"])
            else:
                assert not ok
            own = bins.setdefault(b, {"left": 64, "src": Counter(), "cl": set()})
            own["left"] -= k
            own["src"][s] += 1
            own["cl"].add(c)


def test_clusters_can_be_given(spark):
    rows = [(i, " ".join(words(3, i)), "s%d" % (i % 7), i % 2) for i in range(12)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string, class_id long"), cluster_col="class_id").collect()
    bins = defaultdict(list)
    for x in got:
        bins[x.shard, x.bin].append(x.doc_id % 2)
    assert len(got) == 12 and all(len(b) == len(set(b)) for b in bins.values())


def test_each_step_takes_the_least_residual():
    r = random.Random(5)
    lengths = sorted((r.randint(1, 40) for _ in range(200)), reverse=True)
    sources = [r.choice("abc") for _ in lengths]
    got = best_fit(lengths, sources, [None] * 200, 50, 3)
    left, src = {}, defaultdict(Counter)
    for b, n, s in zip(got, lengths, sources):
        fits = [left[k] for k in left if left[k] >= n and src[k][s] < 3]
        assert (left[b] == min(fits)) if b in left and fits else (b not in left and not fits)
        left[b] = left.get(b, 50) - n
        src[b][s] += 1


def test_packing_keeps_all_tokens(spark):
    rows = [(i, " ".join(words(10 + 37 * (i % 9), i // 2)), "s" if i % 3 else "t") for i in range(120)]
    rows += [(500, " ".join(words(1000, 7)), None), (501, None, "s"), (502, "", "s"), (None, "a b", "s"), (503, "a b", "s"), (503, "A  b", "s")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, bin int")
    got = pack(df, capacity=256, shard_rows=40).collect()
    total = Counter()
    for x in got:
        total[x.doc_id] += x.length
    want = Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").split()) + 1
    assert total == want
    bins = defaultdict(list)
    for x in got:
        bins[x.shard, x.bin].append(x)
    for items in bins.values():
        assert sum(x.length for x in items) <= 256
        assert max(Counter(x.source for x in items).values()) <= 4
        assert all(v == 1 for c, v in Counter(x.cluster for x in items).items() if c is not None)
    assert pack(df.limit(0)).count() == 0
