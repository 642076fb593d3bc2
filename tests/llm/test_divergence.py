import random
import re
from collections import Counter, defaultdict

import pytest

from scholia.llm import divergence as D

TERM = re.compile("[A-Za-z\x80-\U0010ffff]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_audit(docs, top=200):
    """Every group against its lang and against every other, term by term."""
    n, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source, t = lang or "", source or "", terms(text)
        groups[lang].add(source)
        n[lang, source].update(t)
        holders[lang].update(set(t))
    out = []
    f = lambda p, q: (p - q) * (p - q) // q
    for lang, sources in groups.items():
        kept = sorted(t for t, c in holders[lang].items() if c >= 3)
        count = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        share = lambda c, v=len(kept): {t: 1 + 10**9 * (x + 1) // (sum(c.values()) + v) for t, x in c.items()}
        p = {s: share(count[s]) for s in sources}
        q = share({t: sum(count[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            own = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def sample(seed, sources, n):
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Éa", "éa", "zß", "日本", "aB", "AB"]
    docs = []
    for _ in range(n):
        s = r.randrange(sources)
        words = r.choices(vocabulary, weights=[1 + 20 * ((k + s) % 11 == 0) + 100 / (k + 1) for k in range(len(vocabulary))], k=r.randint(0, 40))
        docs.append((r.choice([" ", "3", "-"]).join(words), r.choice(["en", "en", "de"]), f"s{s}"))
    docs += [("wa " * 5000, "en", "hot")] * 3 + [(None, None, None), ("x y z", None, "s1"), ("only once", "xx", "a"), (None, "xx", "b"), ("same same", "fr", "a"), ("same", "fr", "b"), ("same", "fr", None), ("", "en", "bare")]
    return docs


@pytest.mark.parametrize(("sources", "tile", "top"), [(6, 256, 200), (30, 8, 5)])
def test_against_every_term(spark, monkeypatch, sources, tile, top):
    monkeypatch.setattr(D, "TILE", tile)
    docs = sample(sources, sources, 500)
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], "text string, lang string, source string, n int, item string").repartition(6)
    if tile != 256:
        # tasks read the module's own number of a tile, so the sums are asked for here
        got = _in_one_process(spark, df, monkeypatch, top)
    else:
        got = sorted(tuple(r) for r in D.divergence(df, top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(docs, top)


def _in_one_process(spark, df, monkeypatch, top):
    """The audit with what tasks do done here, so that a smaller tile reaches it."""
    import pyarrow as pa

    frame = type(df)
    ours = frame.mapInArrow

    def here(self, fn, schema, *args):
        if "a long, b long" not in str(schema):
            return ours(self, fn, schema, *args)
        table = self.coalesce(1).toArrow()
        batches = list(fn(iter(table.to_batches(max_chunksize=37))))
        return spark.createDataFrame(pa.Table.from_batches(batches).to_pandas(), schema)

    monkeypatch.setattr(frame, "mapInArrow", here)
    return sorted(tuple(r) for r in D.divergence(df, top).select("lang", "source", "part", "item", "value", "rank").collect())


def test_few_buckets_are_evaluated(spark):
    """What the second pass reads is bounded by the k-th value of the first."""
    docs = sample(4, 5, 800)
    got = D.divergence(spark.createDataFrame(docs, "text string, lang string, source string"), 3).where("part = 'term'")
    want = [x for x in plain_audit(docs, 3) if x[2] == "term"]
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == want


def test_empty(spark):
    assert D.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    none = D.divergence(spark.createDataFrame([(None, None, None), (None, None, "b")], "text string, lang string, source string")).collect()
    assert sorted((r.source, r.part, r.item, r.value, r.rank) for r in none) == [("", "pair", "b", 0, 1), ("b", "pair", "", 0, 1)]
