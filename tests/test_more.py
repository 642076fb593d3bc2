import json

import pytest
from pyspark.sql import functions as F

from scholia.functions.tables import canonical_table
from scholia.operators import downloads as D
from scholia.operators import stamps
from scholia.operators.evaluate import table_scores
from scholia.schemas import CATALOG
from scholia.sources.benchmarks import page_truth


def test_tables(spark):
    t = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
    cases = [
        (t, t, 100.0),
        ("", t, None),
        (None, None, None),
        (t, "", 0.0),
        (t, None, 0.0),
        (t, t.replace("<tr><td>c</td><td>d</td></tr>", ""), 100 * (1 - 3 / 7)),
        (t, t.replace("<tr>", "<thead><tr>", 1).replace("td>", "th>"), 100.0),
        (t, t.replace("<td>a", '<td colspan="2">a'), 100 * (1 - 1 / 7)),
        (t, t.replace(">a<", ">x<"), 100 * (1 - 1 / 7)),
        # a true table without a partner counts, one too many doesn't
        (t + t, t, 50.0),
        (t, t + t.replace(">a<", ">x<"), 100.0),
        (t + t.replace(">a<", ">x<"), t.replace(">a<", ">x<") + t, 100.0),
        # joining the rows takes both row nodes away and puts one over all cells
        (t, t.replace("</tr><tr>", ""), 100 * (1 - 3 / 7)),
        # an empty row is a leaf
        (t, t.replace("<tr>", "<tr></tr><tr>", 1), 100 * (1 - 1 / 8)),
        # markup and layout don't count, and cells are compared as normalized text
        (t, '<html><body><table class="x" border="1"><colgroup><col></colgroup><tbody>' + t[7:-8].replace(">a<", '><b>A</b><sub></sub> $\\mathrm{}$<'.replace("A", "a")) + "</tbody></table>", 100.0),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "id int, truth string, found string")
    got = {r.id: r.teds for r in table_scores(df, ["id"]).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert got[i] == (want if want is None else pytest.approx(want)), i


def test_canonical_table(spark):
    html = '<TABLE class="a" width="3"><colgroup><col></colgroup><thead><tr><th>x</th><th colspan="2" style="b">y<sup>2</sup></th></tr></thead></TABLE>'
    got = spark.createDataFrame([(html,)], "h string").select(canonical_table(F.col("h"))).first()[0]
    assert got == '<TABLE><thead><tr><td>x</td><td colspan="2">y2</td></tr></thead></TABLE>'


@pytest.mark.parametrize(
    "text,want",
    [
        ("# A **b** c", "Abc"),
        ("| a | b |\n| --- | --- |", "ab"),
        (r"$\frac{a}{b}$ and \mathbf{x}_1^{2}", "abandx12"),
        (r"\alpha + \times3 \unknown{k} \% 5 \\beta", "αx3k5beta"),
        (r"\alphabet", ""),
        ("x<sub>2</sub> y < z\nnext", "x2ynext"),
        ("ﬁne ½ 5°", "fine125deg"),
        ("0. 45", "045"),
        (None, ""),
    ],
)
def test_normalized_text(spark, text, want):
    from scholia.operators.evaluate import normalized_text

    assert spark.createDataFrame([(text,)], "t string").select(normalized_text(F.col("t"))).first()[0] == want


def test_common_count(spark):
    import random
    from collections import Counter

    from scholia.operators.evaluate import common_count

    r = random.Random(1)
    rows = [([r.choice("abcd") for _ in range(r.randint(0, 9))], [r.choice("abce") for _ in range(r.randint(0, 9))]) for _ in range(80)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", common_count(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(x.n == sum((Counter(x.a) & Counter(x.b)).values()) for x in got)


def test_resolvers(spark):
    best = json.dumps({"best_oa_location": {"url_for_landing_page": "land"}, "oa_locations": [{}, {"url_for_pdf": "pdf"}]})
    rows = [("10.48550/arXiv.1", None, None, ["u"]), ("10.1/x", best, "pmc", []), ("10.1/x", "{}", "pmc", []), ("10.1/x", None, None, ["u"]), ("10.1/x", None, None, [])]
    df = spark.createDataFrame(rows, "doi string, unpaywall string, pmc_url string, download_urls array<string>")
    assert [(r.url, r.resolver) for r in D.resolved(df).collect()] == [("https://arxiv.org/pdf/1", "arxiv"), ("pdf", "unpaywall"), ("pmc", "pmc"), ("u", "provider"), (None, "not_found")]


def test_fetched_files(spark):
    rows = [("a", b"%PDF" + b"x" * 100), ("b", b"<html>sign in</html>"), ("c", b"<html><article>" + b"w " * 400), ("d", b"zip"), ("e", b"%PDF")]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "key string, content binary")
    got = D.verified(df, spark.createDataFrame([("e",)], "key string"))
    assert {r.key: r.outcome for r in got.collect()} == {"a": "stored", "b": "paywall", "c": "stored", "d": "not_a_document"}
    assert tuple(D.batch_report(got).first()) == (2, 0, 2)


def test_stamps(spark):
    cat = spark.createDataFrame([{"stem": s, "markdown_path": "old"} for s in ("a", "b", "c")], CATALOG)
    res = spark.createDataFrame([("a", "vlm", 2, 3, "ok", "new"), ("b", "vlm", 1, 1, "stub", "no")], "stem string, server string, duration_secs int, total_pages int, outcome string, key string")
    got = {r.stem: r for r in stamps.stamp_conversion(cat, res, F.lit("t")).collect()}
    assert got["a"].conversion.failed is False and got["a"].markdown_path == "new" and got["a"].conversion.total_pages == 3
    assert got["b"].conversion.reason == "stub" and got["b"].markdown_path == "old" and got["c"].conversion is None
    emb = spark.createDataFrame([("a", "gpu", 4, "cuda"), ("b", "gpu", 0, "cuda")], "stem string, server string, chunks int, device string")
    got = {r.stem: r for r in stamps.stamp_embedding(cat, emb, F.lit("t")).collect()}
    assert got["a"].embedding.chunks_indexed == 4 and got["b"].embedding is None and got["b"].embedding_skip.reason == "zero_chunks"


def test_rewrites(spark):
    cat = spark.createDataFrame([("a b",), ("a%20b",), ("c%20d",)], "stem string")
    assert sorted(r.stem for r in stamps.without_encoded_twins(cat).collect()) == ["a b", "c%20d"]
    md = spark.createDataFrame([("x", "k", "\n# Title\n\n---\n\ntwo"), ("a b", "k", "y")], "stem string, key string, markdown string")
    assert [tuple(r) for r in stamps.rows_from_markdown(md, cat).collect()] == [("x", "Title", 2, "k")]
    keys = spark.createDataFrame([("m/abc.md",), ("m/ab/abc.md",), ("m/a.md",)], "key string")
    assert [tuple(r) for r in stamps.shard_moves(keys, "m").collect()] == [("m/abc.md", "m/ab/abc.md")]


def test_page_truth(spark, tmp_path):
    det = lambda c, order=None, **x: {"category_type": c, "order": order, **x}
    page = lambda lang, dets: {"page_info": {"image_path": lang + ".png", "page_no": 1, "page_attribute": {"language": lang, "data_source": "book"}}, "layout_dets": dets}
    data = [page("english", [det("text_block", 2, text="two"), det("title", 1, text="one"), det("text_block", None, text="last"), det("table", 3, html="<table></table>"), det("equation_isolated", 4, latex="x")]), page("other", [])]
    (tmp_path / "o.json").write_text(json.dumps(data))
    (r,) = page_truth(spark, str(tmp_path / "o.json"), language="english", tables=True, formulas=True).collect()
    assert (r.text, r.table_html, r.formulas) == ("one\ntwo\nlast", "<table></table>", ["x"])
    assert page_truth(spark, str(tmp_path / "o.json")).count() == 2
