import itertools
import math

import pytest

from scholia.llm import near_join as N
from tests.llm.helpers import WORD, edited, words


def brute(rows, threshold=0.8):
    def shingles(t):
        w = WORD.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {}
    for i, t in rows:
        if i is not None and shingles(t):
            sets.setdefault(shingles(t), set()).add(i)
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    links = dict.fromkeys(sets, 0)
    for ids in sets.values():
        for i in ids:
            join(i, min(ids))
    for a, b in itertools.combinations(sets, 2):
        c = len(a & b)
        if c >= threshold * (len(a) + len(b) - c) - 1e-12:
            links[a] += 1
            links[b] += 1
            join(min(sets[a]), min(sets[b]))
    return {i: (find(i), links.get(shingles(t), 0)) for i, t in rows if i is not None}


def corpus():
    rows, n = [], 0
    for g in range(12):
        base = words(60 + 10 * g, g)
        rows.append((n, " ".join(base)))
        n += 1
        for k in range(g % 5):
            rows.append((n, " ".join(edited(base, 1 + k // 2, 100 * g + k))))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, ""), (n + 3, None), (n + 4, " \n"), (n + 5, "one two"), (n + 6, "one two"), (n + 7, ""), (None, rows[1][1])]
    return rows


def check(spark, rows):
    got = N.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r.doc_id is None:
            assert r.class_id is None
        else:
            assert (r.class_id, r.n_links) == want[r.doc_id], r
    return {r.doc_id: r for r in got}


def test_against_brute_force(spark):
    rows = corpus()
    got = check(spark, rows)
    assert got[0].n_copies == 3


def test_large_alike_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    base = words(300, 5)
    rows = [(i, " ".join(edited(base, 2, i))) for i in range(40)] + [(100 + i, " ".join(words(80, 1000 + i))) for i in range(10)]
    check(spark, rows)


@pytest.mark.parametrize("blocks", [1, 3])
def test_blocks_and_tiles(spark, monkeypatch, blocks):
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "BLOCKS", blocks)
    base = words(300, 6)
    check(spark, [(i, " ".join(edited(base, 1 + i % 3, i))) for i in range(45)])


def test_repeated_rows_link_once(spark):
    base = words(100, 7)
    rows = [(7, " ".join(base)), (7, " ".join(base)), (8, " ".join(edited(base, 1, 1))), (8, "another text of one id that is not alike")]
    got = N.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_copies, r.n_links, r.n_linked_docs) for r in got) == [(7, 7, 2, 1, 1), (7, 7, 2, 1, 1), (8, 7, 1, 1, 2), (8, 7, 1, 1, 2)]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_join(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f", "x", 3), (2, "a b c d e f", "y", 4)], "doc_id long, text string, id string, sketch int")
    assert {(r.doc_id, r.class_id, r.n_copies) for r in N.near_join(rows).collect()} == {(1, 1, 2), (2, 1, 2)}


def test_runs_reach_the_recall():
    assert 4 <= N.runs_for(0.8, 5e-6) <= N.SKETCH // 2 // N.FANOUT
    assert N.runs_for(0.8, 0.5) == 1
    k = N.least_agreement(0.8, 5e-6)
    tail = lambda k: sum(math.comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(k))
    assert tail(k) <= 5e-6 < tail(k + 1)


@pytest.mark.parametrize("n", [1, 3])
def test_very_long_text(spark, n):
    text = " ".join(words(20000, 9))
    rows = [(i, text + (" tail" * i)) for i in range(n)]
    check(spark, rows)
