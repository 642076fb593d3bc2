import math
import zlib
from collections import Counter

import pytest

from scholia.llm.lm_score import lm_scores
from tests.llm.helpers import WORD, words


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def corpus():
    vocabulary = words(60, 1)
    rows = []
    for i in range(300):
        # each word is followed by one of two fixed ones, so that histories tell much
        k, out = i % 60, []
        for j in range(30):
            out.append(vocabulary[k])
            k = (k * 7 + 3 + (i + j) % 2) % 60
        rows.append((i, " ".join(out)))
    return rows + [(1000, None), (1001, ""), (1002, "Zz ÄÖ zz"), (None, rows[0][1]), (7, rows[7][1])]


def test_base_is_exact_and_the_model_better(spark):
    rows = corpus()
    got = lm_scores(spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, score double")).collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    toks = lambda t: WORD.findall(lower(t or "")) + ["\0"]
    count = Counter(w for i, t in rows if not out(i) for w in toks(t))
    n, v = sum(count.values()), len(count)
    text = dict(rows)
    better = [0, 0]
    for r in got:
        w = toks(text[r.doc_id])
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert r.held_out == out(r.doc_id) and r.n_tokens == len(w) and r.train_tokens == n
        assert r.n_known == sum(x in count for x in w)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score < 0
        if r.held_out and r.n_tokens > 5:
            better[0] += r.score > r.base_score
            better[1] += 1
    assert better[0] >= 0.9 * better[1] > 0


def test_probabilities_sum_to_one():
    import numpy as np

    from scholia.llm.lm_score import CLASSES, MEMBERS, SLOTS, START, Weights

    rng = np.random.default_rng(0)
    w = Weights.start(rng.random(SLOTS) + 0.1)
    w.classes[:] += rng.normal(size=w.classes.shape) * 0.3
    w.members[:] += rng.normal(size=w.members.shape) * 0.3
    back = np.array([[3], [START], [START]])
    p = np.exp(w.log_probability(np.arange(SLOTS), np.repeat(back, SLOTS, 1)))
    assert CLASSES * MEMBERS == SLOTS and p.sum() == pytest.approx(1, abs=1e-5)


def test_no_training_rows_and_empty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm_scores(df, F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.base_score == pytest.approx(0)
    assert lm_scores(df.limit(0)).count() == 0


def test_every_token_makes_a_step():
    import numpy as np
    import pyarrow as pa

    from scholia.llm import lm_score as L

    texts = [" ".join(words(2000 + i, i)) for i in range(20)] + ["", "one"]
    lex = L.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(L.SLOTS), 0, 0)
    seen = []

    class Steps:
        def step(self, slot, back):
            assert back.shape == (3, len(slot))
            seen.append(slot)

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    L.walk(Steps(), lex, [batch, batch])
    h, t, n = L.tokens(batch.column(0))
    slot = lex.look_up(h, t)[0]
    assert np.array_equal(np.concatenate(seen), np.concatenate([slot, slot])) and max(map(len, seen)) <= L.BATCH


def plain_scores(rows, rounds):
    """The model of a corpus that one task trains on, token by token with plain loops."""
    import numpy as np
    import pyarrow as pa

    from scholia.llm import lm_score as L
    from scholia.llm.textvec import mix64

    mix = lambda x: int(mix64(np.array([x], dtype=np.uint64))[0])
    ids = {}  # hash and hash of the ending of each token

    def toks(t):
        w = [lower(x) for x in WORD.findall(t or "")] + ["\0"]
        h, tail, _ = L.tokens(pa.array([t or ""]))
        ids.update({x: (int(a), int(b)) for x, a, b in zip(w, h, tail)})
        return w

    train = {i: toks(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10 != 0}
    every = {i: toks(t) for i, t in rows}
    count = Counter(w for t in train.values() for w in t)
    rank = sorted(count, key=lambda w: (-count[w], ids[w][0] - (1 << 64) * (ids[w][0] >> 63)))
    per = L.OWN_SLOTS // L.MEMBERS
    own = {w: (k % per) * L.MEMBERS + k // per for k, w in enumerate(rank[: L.OWN_SLOTS])}
    slot = lambda w: own.get(w, L.OWN_SLOTS + ids[w][1] % (L.SLOTS - L.OWN_SLOTS))
    mass = [0.1] * L.SLOTS
    for w, c in count.items():
        mass[slot(w)] += c + 0.1
    share = [math.log(x / sum(mass)) for x in mass]
    table = {}  # row name to weights
    first_class = [math.log(sum(math.exp(x) for x in share[c * L.MEMBERS : (c + 1) * L.MEMBERS])) for c in range(L.CLASSES)]

    def steps(t):
        s = [slot(w) for w in t]
        for k in range(len(s)):
            b = [s[k - j] if k >= j else L.START for j in (1, 2, 3)]
            single = L.SLOTS + 1
            c = s[k] // L.MEMBERS
            by_class = [("c", 0, b[0]), ("c", 1, b[1]), ("c", 2, b[2]), ("c", 3, mix(b[0] * single + b[1]) % L.PAIR_ROWS)]
            by_member = [("m", mix((j * single + b[j]) * L.CLASSES + c) % (L.MEMBER_ROWS - L.CLASSES)) for j in (0, 1)]
            yield c, s[k] % L.MEMBERS, by_class, by_member

    def soft(bias, rows_):
        z = [x + sum(table.get(r, [0.0] * len(bias))[k] for r in rows_) for k, x in enumerate(bias)]
        top = max(z)
        total = sum(math.exp(x - top) for x in z)
        return [x - top - math.log(total) for x in z]

    def members(c):
        return share[c * L.MEMBERS : (c + 1) * L.MEMBERS]

    for part in rounds:
        grad = {}
        for i in part:
            for c, m, by_class, by_member in steps(train[i]):
                for bias, rows_, right in ((first_class, by_class, c), (members(c), by_member, m)):
                    g = [math.exp(x) - (k == right) for k, x in enumerate(soft(bias, rows_))]
                    for place, r in enumerate(rows_):
                        into = grad.setdefault((r, place), [0.0] * len(g))
                        for k, x in enumerate(g):
                            into[k] += x
        seen = {}
        for (r, _), g in sorted(grad.items(), key=lambda x: x[0][1]):
            seen[r] = seen.get(r, 0.0) + sum(x * x for x in g) / len(g)
            old = table.get(r, [0.0] * len(g))
            table[r] = [w - L.RATE * x / math.sqrt(seen[r] + 1) for w, x in zip(old, g)]
    out = {}
    for i, t in every.items():
        p = 0.0
        for w, (c, m, by_class, by_member) in zip(t, steps(t)):
            p += soft(first_class, by_class)[c] + soft(members(c), by_member)[m] + math.log(count[w] + 0.1) - math.log(mass[slot(w)])
        out[i] = p / math.log(10)
    return out


def test_score_against_plain_loops(spark):
    vocabulary = words(12, 3)
    rows = [(i, " ".join(vocabulary[(i * k + k * k) % 12] for k in range(9))) for i in range(24)] + [(50, "new words here"), (51, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    part = {r.doc_id: r.k for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id, coalesce(text, '')), 2) AS k").collect()}
    learned = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 != 0]
    want = plain_scores(rows, [[i for i in learned if part[i] == k] for k in (0, 1)])
    for r in lm_scores(df).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=2e-3), r
