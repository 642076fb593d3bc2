"""The findings of round 3 on larger tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F


def _plan(df, optimized=False):
    execution = df._jdf.queryExecution()
    return str((execution.optimizedPlan() if optimized else execution.executedPlan()).toString())


@pytest.mark.parametrize("name", ["chunk_documents", "index_points"])
def test_f8_f11_texts_are_cut_once(spark, sf, name):
    from __spark_entry__ import queries

    plan = _plan(queries()[name](spark, sf))
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == (name == "index_points")


def test_f8_f11_chunks_are_handed_on_some_at_a_time(spark):
    import pyarrow as pa

    from scholia.operators.chunk import GATHERED, _chunk_rows, chunk_spans, chunks

    texts = ["Some words. " * 20_000, None, " ", "short", *["x y. " * 9000] * 60]
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(map(str, range(len(texts)))), pa.array(texts)], names=["doc_id", "_title", "_text"])
    parts = list(_chunk_rows(4000, 400)([given]))
    assert len(parts) > 2 and all(sum(map(len, p.column("raw_text").to_pylist())) < GATHERED + 4004 for p in parts)
    want = [(i, k, len(s), x[5], *x[:5]) for i, t in enumerate(texts) for s in [chunk_spans(t or "")] for k, x in enumerate(s)]
    names = ("doc_id", "chunk_index", "total_chunks", "raw_text", "char_start", "char_end", "line_start", "line_end", "page")
    assert [r for p in parts for r in zip(*[p.column(n).to_pylist() for n in names])] == want
    df = spark.createDataFrame([("a", "one\n\n---\n\ntwo"), (None, "three"), ("c", None)], "doc_id string, text string")
    got = {(r.doc_id, r.chunk_index, r.total_chunks, r.page, r.text) for r in chunks(df).collect()}
    assert {x[:4] for x in got} == {("a", 0, 2, 1), ("a", 1, 2, 2), (None, 0, 1, 1)} and ("a", 1, 2, 2, "a > chunk 1\n\ntwo") in got


def test_f9_grids_are_sorted_once_and_dealt_once(spark, sf):
    from __spark_entry__ import queries

    df = queries()["grid_markup"](spark, sf)
    assert _plan(df, True).count("array_sort(") <= 2 and _plan(df).count("Exchange") == 1


def test_f9_wide_grids(spark):
    from scholia.sources.benchmarks import CELLS, grid_html
    from tests.test_round3 import plain_grid

    r = random.Random(12)
    span = lambda: list(range(k := r.randint(0, 39), k + r.choice([1] * 8 + [2, 5])))
    tables = [[(span(), span(), f"{i}<", r.random() < 0.2) for i in range(n)] for n in (1, 50, 400)] + [[([5, 3], [2], None, None), ([3], [2, 3], "second", True), ([None], [0], "x", None)][:2]]
    df = spark.createDataFrame(list(enumerate(tables)), f"i int, c {CELLS}")
    got = {x.i: x.h for x in df.select("i", grid_html(F.col("c")).alias("h")).collect()}
    assert all(got[i] == plain_grid(t) for i, t in enumerate(tables[:3]))
    assert got[3].count('rowspan="2"') == 1 and "second" not in got[3]


SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def plain_measures(text):
    t = re.sub(f"^[{SPACE}]+|[{SPACE}]+$", "", text or "")
    w = re.findall(f"[^{SPACE}]+", t)
    chars = Counter("".join(w))
    grams = Counter(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 8 else {}
    gram = max(grams.values(), default=0) / max(sum(grams.values()), 1)
    return sum(chars.values()), max(chars.values(), default=0) / max(len(t.encode()), 1), len(set(w)) / len(w) if len(w) >= 20 else 1.0, gram if gram > 0.5 else None


def test_f12_f14_f16_measures_of_odd_texts(spark):
    from scholia.operators.quality import with_quality

    r = random.Random(4)
    few = lambda: r.sample(["a", "b", "ab", "é", "漢字", "😀", "==", "\x1cq", "A", "the"], r.randint(1, 5))
    texts = ["".join(r.choice(w) + r.choice([" ", " ", "\n", " ", "　", "\x1d", "\x85", "  "]) for _ in range(r.choice([0, 3, 30, 300]))) for _ in range(300) for w in [few()]]
    texts += [None, "", " \n", "word " * 500, "a b " * 100, "".join(map(chr, range(0x4E00, 0x6000))), "x" * 30_000, "one two three four " * 9 + "five", "  end \r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for x in with_quality(df).collect():
        non_ws, char, different, gram = plain_measures(texts[x.i])
        assert (x.non_ws, x.char_share, x.diversity) == (non_ws, char, different), texts[x.i]
        assert x.ngram_share == gram if gram else x.ngram_share <= 0.5
        want = "too_short" if non_ws < 50 else "dominant_char" if char > 0.3 else "low_diversity" if different < 0.1 else "dominant_ngram" if gram else None
        assert x.reject_reason == want


def test_f12_f14_f16_measures_are_worked_out_once_and_not_char_by_char(spark, sf):
    from __spark_entry__ import queries

    for name in ("quality_measures", "quality_reasons", "quality_tally"):
        plan = _plan(queries()[name](spark, sf))
        assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan and "split" not in plan


def test_f13_only_pages_of_the_catalog_are_measured(spark, sf):
    from __spark_entry__ import queries

    plan = _plan(queries()["junk_html"](spark, sf), True)
    assert 0 <= plan.find("measures(") < plan.find("Join Inner")


def test_f15_loops_of_odd_texts(spark):
    from scholia.functions.repetition import cleaned
    from tests.test_functions import plain_loops

    def plain(text):
        runs = re.compile(r"(.)\1{10,}", re.S)
        out, sites = plain_loops(runs.sub(r"\1", text))
        return out, sites + len(runs.findall(text))

    r = random.Random(8)
    texts = [" ".join((r.choices(["a", "b", "é", "😀", "w" * 12], k=r.randint(1, 5)) * r.randint(1, 14))[r.randint(0, 3) :]) + r.choice(["", "\n", " ", "\n\nend", "z" * 11, "　" * 12 + "q"]) for _ in range(400)]
    texts += ["", "\n" * 11, "é" * 10, "é" * 11 + "😀" * 25, "a b " * 5000 + "c " * 9]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", cleaned(F.col("v")).alias("c")).collect()
    assert {x.i: tuple(x.c) for x in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_f15_loops_are_looked_for_once(spark, sf):
    from __spark_entry__ import queries

    plan = _plan(queries()["repetition_scan"](spark, sf))
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan


def test_f17_only_the_first_words_are_cleaned(spark, tmp_path):
    from __spark_entry__ import queries

    r = random.Random(2)
    texts = ["".join(r.choice(["a", "b", "cd", " ", " ", "  ", "A", "-", "\n", "é", "😀"]) for _ in range(r.randint(0, 30))) for _ in range(600)] + [None, "", " ", "one", "- a - b - c - d - e", "word " * 20_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries()["latex_texts"](spark, str(tmp_path))
    for x in df.collect():
        w = re.split(" +", re.sub("[^a-z ]", "", texts[x.doc_id] or "")) + [""] * 4
        a, b, c = w[1:4]
        assert x.plain == f"{a}/{b}/{c} × α{a}{b}≤ {x.doc_id}", texts[x.doc_id]
    assert _plan(df, True).count("regexp_replace(") == 1
