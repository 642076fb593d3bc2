"""The findings of round 4."""

import random

import pytest


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def _words(r, n, least=0, letters="abcé漢"):
    return "".join(r.choice(letters) for _ in range(r.randint(least, n)))


@pytest.mark.parametrize("wide", [1, 10**9])
def test_f2_edits_of_many_asks_at_once(monkeypatch, wide):
    from scholia.functions import edits

    monkeypatch.setattr(edits, "WIDE", wide)
    monkeypatch.setattr(edits, "LANES", 20)
    r, asks = random.Random(1), []
    for _ in range(150):
        text, stream = _words(r, r.choice([3, 64, 65, 200])), _words(r, r.choice([5, 70, 150]))
        first = r.randint(0, len(stream))
        asks.append((text, stream, first, sorted(r.randint(0, len(stream) - first) for _ in range(3))))
    assert edits.edits_of(asks) == [[_plain(t, s[f:])[e] for e in ends] for t, s, f, ends in asks]


def test_f2_windows_of_many_blocks_at_once(monkeypatch):
    from scholia.functions import edits

    monkeypatch.setattr(edits, "WINDOWS", 90)
    r = random.Random(2)
    for _ in range(20):
        text, blocks = _words(r, 20, 10), [_words(r, 60, 30) for _ in range(3)]
        widths, step = [[7, 10, len(b) - k] for k, b in enumerate(blocks)], r.randint(1, 5)
        want = [[[_plain(text, b[o : o + w])[-1] for o in range(0, len(b) - w + 1, step)] for w in ws] for b, ws in zip(blocks, widths)]
        assert [[list(x) for x in rows] for rows in edits.window_edits(text, blocks, step, widths)] == want


def test_f3_large_pages_are_scored_by_blocks(spark):
    from scholia.operators.blocks import block_scores

    r = random.Random(3)
    text = lambda n: _words(r, n, n, "abcdefghijklmnopqrstuvwxyz")
    many = [text(30) for _ in range(60)]
    split = [x for t in many for x in ((t[:15], t[15:]) if t == many[40] else (t,))]
    long = [text(7000) for _ in range(4)]
    rows = [(1, many, many[::-1]), (2, many, split[45:] + split[:45]), (3, long, long[::-1]), (4, many, many[30:] + [text(30) for _ in range(30)])]
    got = {x.id: x for x in block_scores(spark.createDataFrame(rows, "id int, truth array<string>, found array<string>"), ["id"]).collect()}
    # of more pairs than 2500, with one block in two parts among more than 50, and of more bytes than 50,000
    assert [got[k].score for k in (1, 2, 3)] == [100.0] * 3 and all(got[k].whole < 60 for k in (1, 2, 3))
    assert got[4].whole < got[4].score < 100
