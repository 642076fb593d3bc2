import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scholia.llm import lexical_search as S

TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    """All documents scored for each item, one after another."""
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def sample(seed, n):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 30 + [f"w{k}" for k in range(60)] + ["Été", "über", "x1", "İ", "straße", "ÉTÉ", "日本"]
    text = lambda a, b: r.choice([" ", ", ", "-", "_"]).join(r.choices(vocabulary, k=r.randint(a, b)))
    docs = [(i, text(1, 80)) for i in range(n)] + [(1000 + i, "the w1 w2 copy") for i in range(40)]
    docs += [(7, text(3, 9)), (None, "w1 w3"), (None, None), (2000, ""), (2001, "?!"), (2002, "the " * 3000 + "w5"), (1003, "the w1 w2 copy")]
    items = [(i, text(1, 30)) for i in range(25)] + [(30, None), (31, "..."), (32, "unknownterm"), (33, "W1 w2 COPY copy"), (33, "W1 w2 COPY copy"), (34, "w7"), (34, "w8 w8"), (None, "w9")]
    return docs, items


@pytest.mark.parametrize(("block", "cells"), [(1 << 16, 1 << 22), (60, 64)])
def test_against_scoring_everything(spark, monkeypatch, block, cells):
    monkeypatch.setattr(S, "BLOCK_TERMS", block)
    docs, items = sample(1, 300)
    df = spark.createDataFrame([(*d, 5, "q") for d in docs], "doc_id long, text string, score int, rank string").repartition(5)
    own = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    # the tasks have the module's own sizes; smaller slices are tried below
    got = sorted((tuple(r) for r in S.search(df, own).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain_search(docs, items)


def test_bounds_hold_the_score():
    r = np.random.default_rng(2)
    tf, m = r.integers(1, 10**6, 10000), r.integers(25, 10**7, 10000)
    exact = S.impacts(tf, m)
    quantised = -(-exact // S.STEP)
    assert quantised.max() <= 255 and (exact <= quantised * S.STEP).all() and (exact[quantised > 0] > ((quantised - 1) * S.STEP)[quantised > 0]).all()
    assert S.impacts(np.array([1]), np.array([25])).tolist() == [10**9 // 1200]


def test_few_documents_are_scored_again(spark, monkeypatch):
    docs, items = sample(3, 400)
    block = S.Items.of([(i, t) for i, text in items[:25] if (t := terms(text))])
    counted = S._counted(spark.createDataFrame(docs, "doc_id long, text string"), block)
    index = S._indexed(counted, 440, 20000).cache()
    weights = [np.full(b - a, 1000) * block.times[a:b] for a, b in zip(block.at, block.at[1:])]
    low = S._lowest(index, block, [w.astype(float) for w in weights], 10)
    assert (low > 0).sum() > 15
    rows = index.collect()
    reach = 0
    for j in range(len(block.names)):
        w = dict(zip(block.ids[block.at[j] : block.at[j + 1]].tolist(), weights[j].tolist()))
        upper = [sum(w.get(i, 0) * b for i, b in zip(x.ids, x.bytes)) for x in rows]
        lower = sorted((sum(w.get(i, 0) * (b - 1) for i, b in zip(x.ids, x.bytes)) for x in rows), reverse=True)
        assert low[j] == (lower[9] if lower[9] > 0 else 0)
        reach += sum(u >= low[j] and u > 0 for u in upper)
    assert reach < 0.5 * len(rows) * len(block.names)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert S.search(docs, items).count() == 0
    assert S.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0
    assert [tuple(r) for r in S.search(spark.createDataFrame([(1, "A b"), (2, "c")], "doc_id long, text string"), items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]
