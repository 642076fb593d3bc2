"""The pipeline's stages against plain versions of them, on a small table with odd rows."""

from collections import Counter

import corpus_pipeline as P
from scholia.llm.substring_dedup import MIN_WORDS
from tests.llm.helpers import edited, words
from tests.llm.test_near_join import brute
from tests.llm.test_quality_rules import brute as measures
from tests.llm.test_substring_dedup import plain_chunks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(ws):
    out = []
    for i, w in enumerate(ws):
        out += [w] + (["the"] if i % 6 == 0 else [])
    return " ".join(out)


def table():
    shared = prose(words(70, 900))
    texts = []
    for i in range(30):
        t = prose(words(150, i))
        if i % 5 == 0:
            t += "\n" + shared + "\n" + prose(words(40, 300 + i))
        texts.append(t)
    texts += [texts[1], prose(edited(words(150, 2), 2, 7)), " ".join(words(100, 55)), "###$$$ " * 40, "x", "", None, shared]
    rows = [(i, t, "en", None if i % 11 == 3 else f"s{i % 4}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[4], (None, prose(words(90, 77)), None, None, None), (None, None, None, None, None)]
    return rows


def key(rows):
    return Counter((r[0], r[1]) for r in rows)


def test_stages(spark, tmp_path):
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [f for _, f in P.STAGES]
    # rules
    got = [tuple(r) for r in names[0](spark, docs, "").collect()]
    clean = [r for r in rows if r[1] and measures(r[1])[0] >= 10 and not r[1].startswith("###") and "the" in r[1].split() and len(r[1].split()) > 20]
    assert key(got) == key(clean)
    # near duplicates
    docs = spark.createDataFrame(got, SCHEMA)
    near = [tuple(r) for r in names[1](spark, docs, "").collect()]
    classes = brute([(r[0], r[1]) for r in got])
    want = {(r[0], r[1]) for r in got if r[0] is None or classes[r[0]][0] == r[0]}
    assert key(near) == Counter(want)
    # repeated passages: chunk by chunk, in the order of ids
    docs = spark.createDataFrame(near, SCHEMA)
    cut = {r.doc_id: r for r in names[2](spark, docs, "").collect() if r.doc_id is not None}
    seen = set()
    for r in sorted((r for r in near if r[0] is not None), key=lambda r: r[0]):
        run, lost = [], 0
        for c in plain_chunks(r[1]) + [None]:
            if c is not None and c in seen:
                run.append(len(c.split()))
                continue
            lost += sum(run) if sum(run) >= MIN_WORDS else 0
            run = []
            if c is not None:
                seen.add(c)
        left = len(r[1].split()) - lost
        if left:
            # a word may be joined to its neighbour where a span ends without white space
            assert abs(len(cut[r[0]].text.split()) - left) <= 1, r[0]
            assert cut[r[0]].n_chars == (len(cut[r[0]].text))
        else:
            assert r[0] not in cut
    assert sum(len(x.text) < len(dict((r[0], r[1]) for r in near)[i]) for i, x in cut.items()) >= 5
    # mixing keeps all rows; packing all words
    third = names[2](spark, docs, "").collect()
    mixed = names[3](spark, spark.createDataFrame(third, SCHEMA), "")
    assert key(mixed.collect()) == key(third) and mixed.columns == P.COLUMNS
    mixed.write.parquet(f"{tmp_path}/mixed")
    bins = names[4](spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    assert sum(b.length for b in bins) == sum(len(r.text.split()) + 1 for r in third)


def test_run(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    bins = P.run(spark, str(tmp_path)).collect()
    assert {b.doc_id for b in bins} >= {0, 1, 2, 3, 4} and None in {b.doc_id for b in bins}
    assert all(sum(b.length for b in bins if (b.shard, b.bin) == k) <= 2048 for k in {(b.shard, b.bin) for b in bins})


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
