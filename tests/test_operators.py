import random

import pytest
from pyspark.sql import functions as F

from scholia.functions.text import normalized_title
from scholia.operators import catalog as C
from scholia.operators import evaluate as E
from scholia.operators import layout as L
from scholia.operators import quality as Q
from scholia.operators import status as S
from scholia.operators import vectors as V
from scholia.operators.chunk import chunk_spans
from scholia.operators.dedup import dedup, dedup_stats, leaders, similar_titles
from scholia.operators.merge import merge_groups, ranked
from scholia.plans.metasearch import metasearch
from scholia.plans.written import written
from scholia.schemas import PAPERS

WEIGHT = {"semantic_scholar": 1.0, "openalex": 0.9, "arxiv": 0.8, "europe_pmc": 0.7, "crossref": 0.6}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    return 1.0 if not a and not b else 1 - distance(a, b) / max(len(a), len(b))


def papers(n=90, seed=1):
    r = random.Random(seed)
    base = ["".join(r.choices("abcdefgh ", k=r.randint(3, 40))) for _ in range(20)]
    rows = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice("xyz")
        doi = None if i % 3 else f"10.1/{r.randint(0, 12)}"
        rows.append((f"p{i:03d}", "".join(t), [("n", [])], None if i % 4 else "abc", None, doi, [f"u{i % 5}"], i % 7 or None, r.choice([*WEIGHT, "core"]), i // 6))
    return rows


def greedy(rows, keys):
    order = sorted(range(len(rows)), key=lambda i: (-WEIGHT.get(rows[i][8], 0.5), rows[i][9], rows[i][0]))
    groups, by_doi = [], {}
    for i in order:
        if rows[i][5]:
            d = rows[i][5].lower()
            if d not in by_doi:
                by_doi[d] = [i]
                groups.append(by_doi[d])
            else:
                by_doi[d].append(i)
    for i in order:
        if not rows[i][5]:
            for g in groups:
                if similar(keys[rows[i][0]], keys[rows[g[0]][0]]) >= 0.85:
                    g.append(i)
                    break
            else:
                groups.append([i])
    return {frozenset(rows[i][0] for i in g) for g in groups}


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_is_the_greedy_one(spark, seed):
    rows = papers(seed=seed)
    df = spark.createDataFrame(rows, PAPERS)
    keys = {r.id: r.k for r in df.select("id", normalized_title("title").alias("k")).collect()}
    got = {}
    out = dedup(df, written).cache()
    for r in out.collect():
        got.setdefault(r.group_key, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == greedy(rows, keys)
    s = dedup_stats(out).first()
    assert s.unique == s.total_raw - s.doi_matches - s.fuzzy_matches == len(got)


def test_no_similar_pair_is_lost(spark):
    df = spark.createDataFrame(papers(120, 5), PAPERS)
    titles = leaders(df).collect()
    want = set()
    for a in titles:
        for b in titles:
            if b["at"]["kind"] == 1 and a["at"] < b["at"] and similar(a.title_key, b.title_key) >= 0.85:
                want.add((a.key, b.key))
    assert {(r.a, r.b) for r in similar_titles(leaders(df)).collect()} == want


def test_merge_policies(spark):
    rows = [
        ("a", "short", [("x", [])], None, None, "10.1/A", ["u1"], None, "arxiv", 0),
        ("b", "longer title", [("x", []), ("y", [])], "abs", None, "https://doi.org/10.1/a", ["u2", "u1"], 5, "openalex", 3),
        ("c", "LONGER TITLE", [], "sba", None, "10.1/a", None, 3, "core", 1),
    ]
    from scholia.operators.dedup import doi_groups

    m = merge_groups(doi_groups(spark.createDataFrame(rows, PAPERS)), "doi_key").first()
    assert (m.id, m.title, m.abstract_text, m.doi, m.cited_by_count, m.source) == ("b", "LONGER TITLE", "sba", "https://doi.org/10.1/a", 5, "arxiv+core+openalex")
    assert m.download_urls == ["u2", "u1"] and len(m.authors) == 2
    assert m.rrf == pytest.approx(0.8 / 61 + 0.9 / 64 + 0.5 / 62)


def test_relevance_floor_keeps_the_target(spark):
    rows = [("t", "Graph neural networks survey", [], "graph neural networks", None, None, [], 3, "arxiv", 0), ("o", "Cooking for two people", [], None, None, None, [], 1000, "arxiv", 1)]
    df = spark.createDataFrame(rows, PAPERS)
    got = metasearch(df, "graph neural networks", by_citations=True).collect()
    assert [r.id for r in got] == ["t"] and got[0].relevance > 0.5
    assert len(metasearch(df, "graph neural networks", min_citations=10).collect()) == 1


def test_quality_reasons(spark):
    good = "The quick brown fox jumps over the lazy dog while seven other animals watch from the hill and wonder about it."
    cases = [(good, None), ("Hello world", "too_short"), ("   ", "too_short"), ("", "too_short"), (None, "too_short"), ("g" * 59, "dominant_char"), ("J" * 100, "dominant_char"), ("alpha beta gamma delta " * 20, "low_diversity"), (good + " one two three four" * 3, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    got = {r.i: r.reject_reason for r in Q.with_quality(df).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_gates(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (18, 30), (21, 1), (30, 5), (21, 0), (6, 1)], "t int, p int")
    assert [r[0] for r in df.select(Q.qc_verdict(F.col("t"), F.col("p"))).collect()] == ["accept"] * 3 + ["reject_loop"] * 4
    df = spark.createDataFrame([(1, "x", 5.0), (1, "x" * 600, 0.2), (2, "x", 0.1), (1, "x" * 600, 2.0), (1, "x" * 600, None)], "p int, m string, d double")
    assert [r[0] for r in df.select(Q.is_stub(F.col("p"), F.col("m"), F.col("d"))).collect()] == [True, True, False, False, False]
    pages = [("<article>" + "x" * 600, False), ("please sign in", True), ("<p>short</p>", True), ("x" * 600 + " impact factor", True), ("x" * 600, False)]
    df = spark.createDataFrame(pages, "h string, w boolean")
    assert all(r[0] == r[1] for r in df.select(Q.is_paywall(F.col("h")), "w").collect())


def test_chunks():
    assert chunk_spans("") == [] and len(chunk_spans("short")) == 1
    assert [c[4] for c in chunk_spans("one\n\n---\n\ntwo")] == [1, 2]
    assert chunk_spans("a\nb\nc\nd")[0][2:4] == (1, 4)
    text = " ".join(f"Sentence number {i} é." for i in range(900))
    spans = chunk_spans(text)
    raw = text.encode()
    for s, e, *_, t in spans:
        assert raw[s:e].decode() == t and len(t.encode()) <= 4003
    assert len(spans) > 5 and all(b[0] < a[1] for a, b in zip(spans, spans[1:]))


def test_catalog_directions(spark):
    cat = spark.createDataFrame([("aa", True, False), ("bb", False, False), ("cc", True, True), ("dd", True, False)], "stem string, conv boolean, failed boolean").select(
        "stem", F.when(F.col("stem") != "dd", "t").alias("downloaded_at"), F.lit("markdown/aa.md").alias("markdown_path"), F.when(F.col("conv"), F.struct("failed")).alias("conversion")
    )
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    papers = key("papers/aa/aa.pdf", "papers/bb/bb.html", "papers/bb/bb.pdf", "papers/x/._no.pdf", "papers/zz/zz.pdf", "papers/dd/dd.pdf")
    md = key("markdown/aa.md", "markdown/aa/aa.md", "markdown/bb/bb.md", "markdown/x/._aa.md")
    stems = lambda df: sorted(r.stem for r in df.collect())
    assert stems(C.orphan_files(cat, papers)) == ["zz"]
    assert stems(C.converted_without_markdown(cat, md)) == ["dd"]
    assert stems(C.phantom_rows(cat, papers, md)) == ["cc"]
    assert [tuple(r) for r in C.stuck_convert(cat, papers).collect()] == [("bb", "pdf")]
    assert sorted(tuple(r) for r in C.flag_drift(cat, papers, md).collect()) == [("bb", True, False), ("dd", False, True)]
    plan = {(r.direction, r.stem, r.detail) for r in C.repair_plan(cat, papers, md).collect()}
    assert plan == {
        ("disk_no_catalog", "zz", "pdf"), ("catalog_no_markdown", "dd", None), ("catalog_no_source", "cc", None), ("stuck_convert", "bb", "pdf"),
        ("flag_drift", "bb", "conversion"), ("flag_drift", "dd", "download"), ("path_drift", "aa", "markdown/aa/aa.md"), ("path_drift", "bb", "markdown/bb/bb.md"),
    }
    assert sorted(tuple(r) for r in C.path_drift(cat, md).collect()) == [("aa", "markdown/aa.md", "markdown/aa/aa.md"), ("bb", "markdown/aa.md", "markdown/bb/bb.md")]


def test_reconcile(spark):
    md = spark.createDataFrame([(f"markdown/{s}.md",) for s in "abcde"], "key string")
    idx = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    cat = spark.createDataFrame([("a", 1, None, False), ("b", None, None, False), ("c", None, "zero_chunks", False), ("d", None, "embed_failed: x", False), ("e", None, None, True)], "stem string, e int, r string, f boolean").select(
        "stem", F.when(F.col("e").isNotNull(), F.struct("e")).alias("embedding"), F.when(F.col("r").isNotNull(), F.struct(F.col("r").alias("reason"))).alias("embedding_skip"), F.struct(F.col("f").alias("failed")).alias("conversion")
    )
    got = {r["stem"]: r["class"] for r in C.reconcile(md, idx, cat).collect()}
    assert got == {"a": "ok", "b": "stamp_missing", "c": "ok", "d": "embed_missing", "e": "ok"}


def test_shares_and_drift(spark):
    r = spark.range(1).select(S.share(F.lit(3), F.lit(0)).alias("a"), S.share(F.lit(3), F.lit(2)).alias("b"), S.drift(F.lit(10), F.lit(12), F.lit(1), F.lit(0)).alias("c")).first()
    assert tuple(r) == (0.0, 1.0, 0)


def box(*rows):
    return [("d", 1, *map(float, r[:4]), r[4], r[5], float(i), i) for i, r in enumerate(rows)]


def test_regions(spark):
    from scholia.schemas import REGIONS

    df = lambda rows: spark.createDataFrame(rows, REGIONS)
    kept = lambda rows: sorted(r.unique_id for r in L.suppressed(df(rows)).collect())
    assert kept(box((0, 0, 10, 10, 0.9, "text"), (0, 0, 10, 10, 0.5, "text"), (50, 50, 60, 60, 0.4, "text"))) == [0, 2]
    assert kept(box((0, 0, 10, 10, 0.9, "table"), (0, 0, 10, 9, 0.5, "text"))) == [0]
    assert kept(box((0, 0, 10, 10, 0.9, "text"), (0, 0, 10, 9, 0.5, "table"))) == [0, 1]
    refs = box((0, 0, 100, 100, 0.9, "reference"), (1, 1, 50, 50, 0.9, "reference_content"), (1, 51, 50, 99, 0.9, "reference_content"), (200, 0, 300, 100, 0.9, "reference"), (201, 1, 250, 50, 0.9, "reference_content"))
    assert sorted(r.unique_id for r in L.without_covered_references(df(refs)).collect()) == [1, 2, 3, 4]
    md = df(box((0, 0, 1, 1, 1.0, "doc_title"), (0, 0, 1, 1, 1.0, "image"), (0, 0, 1, 1, 1.0, "header"), (0, 0, 1, 1, 1.0, "display_formula"), (0, 0, 1, 1, 1.0, "inline_formula"))).withColumn("text", F.lit(" x "))
    assert L.page_markdown(md).first().markdown == "# x\n\n![Figure]\n\n$$\nx\n$$\n\n$x$"


def test_scores(spark):
    s = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert s(E.ned(lit(""), lit(""))) == 0.0 and s(E.ned(lit("é"), lit("e"))) == 0.5
    assert s(E.bleu4(lit("the cat sat on the mat"), lit("the cat sat on the mat"))) == pytest.approx(1.0)
    assert s(E.bleu4(lit("a b c d"), lit("w x y z"))) == 0.0 and s(E.bleu4(lit(""), lit("a"))) == 0.0
    assert s(E.cdm(lit("$\\mathbf{x}+\\alpha$"), lit("x+β"))) < 100 and s(E.cdm(lit("$x^2$"), lit("x^2"))) == 100.0
    assert s(E.cdm(lit(""), lit("$$"))) == 100.0 and s(E.cdm(lit("x"), lit(""))) == 0.0
    assert s(E.cdm(lit("\\alpha+b"), lit("α + b"))) == 100.0
    null = lit(None).cast("double")
    assert s(E.composite(lit(50.0), lit(100.0), null, lit(False))) == 100.0
    assert s(E.composite(lit(50.0), null, null, lit(False))) == 50.0 and s(E.composite(null, null, null, lit(True))) == 0.0


def test_vector_table(spark):
    p = spark.createDataFrame([("d1:0", "d1", 1), ("d1:1", "d1", 1), ("d2:0", "d2", 1)], "point_id string, doc_id string, indexed_at int")
    new = spark.createDataFrame([("d1:0", "d1", 2), ("d1:0", "d1", 3)], p.schema)
    assert sorted((r.point_id, r.indexed_at) for r in V.upsert(p, new).collect()) == [("d1:0", 3), ("d2:0", 1)]


def test_topk_plan(spark, sf):
    plan = V.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), [1.0] * 64, 3, "vec_id", where=F.col("label") < 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "PushedFilters: [IsNotNull(label), LessThan(label,5)" in plan


def test_ranked_orders_by_score(spark):
    df = spark.createDataFrame([(0.016, 10000, "abc def"), (0.016, None, "abc def")], "rrf double, cited_by_count bigint, title string").selectExpr("*", "cast(null as string) abstract_text", "cast(null as string) doi", "cast(null as date) publication_date")
    a, b = ranked(df, "abc").collect()
    assert a.score - b.score == pytest.approx(0.25)
