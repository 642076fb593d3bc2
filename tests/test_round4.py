"""The findings of round 3."""

import random

from pyspark.sql import functions as F


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_f1_edits_of_many_texts_at_once():
    from scholia.functions.edits import edits_along

    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcé") for _ in range(r.randint(0, n)))
    for _ in range(200):
        texts, stream = [word(14) for _ in range(r.randint(0, 5))], word(20)
        ends = sorted(r.randint(0, len(stream)) for _ in range(3))
        assert edits_along(texts, stream, ends) == [[_plain(t, stream[:e]) for t in texts] for e in ends]


def test_f1_block_scores_compare_no_texts_in_expressions(spark):
    from scholia.operators.blocks import block_scores

    pages = spark.createDataFrame([(1, ["abcdefghijkl", "mnopqrstuvwx"], ["abcdefghijklmnopq", "rstuvwx"])], "id int, truth array<string>, found array<string>")
    out = block_scores(pages, ["id"])
    # only whole texts beyond the size of a page are
    assert out._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") <= 1
    assert out.first()["score"] == 100.0


def test_f6_sums_of_equal_sets_decide_as_they_are_added():
    from scholia.operators.blocks import cheapest_way

    a, b, c = 0.680233, 0.4766511, 0.3000007
    assert cheapest_way([[a], [a]]) == [None, 0]
    # the same three numbers, whose sum depends on the order in which they are added
    costs = [[b, a, 9.0, 9.0], [9.0, 9.0, c, 9.0]]
    assert cheapest_way(costs) == [0, 2]
    assert cheapest_way([[0.1, 0.9], [0.2, 0.1], [0.1, 0.3]]) == [None, 1, 0]


def test_f2_to_f5_titles_meet_as_texts_not_as_grams(spark):
    from scholia.operators import dedup as D

    r = random.Random(3)
    words = ["model", "result", "theory", "of", "deep", "water", "energy"]
    text = lambda: " ".join(r.choice(words) for _ in range(8))
    texts = [text() for _ in range(60)]
    texts += [t[:-2] + "xy" for t in texts[:20]]
    titles = spark.createDataFrame([(f"k{i}", t, (i % 2, i)) for i, t in enumerate(texts)], "key string, title_key string, at struct<kind:int,pos:int>")
    pairs = D.candidate_titles(titles)
    # nothing of a title is shuffled but its text
    assert "Generate inline" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    similar = lambda a, b: 1 - _plain(a, b) / max(len(a), len(b)) >= 0.85
    asks = {t for i, t in enumerate(texts) if i % 2}
    assert {(x.a, x.b) for x in pairs.collect()} == {(a, b) for a in set(texts) for b in asks if a != b and similar(a, b)}


def test_f7_tables_cell_by_cell(spark):
    from scholia.functions import tables as T

    r = random.Random(5)
    cell = lambda: ("".join(r.choice("ab") for _ in range(r.randint(0, 3))), r.choice([1, 1, 1, 2]), 1)
    rows = []
    for k in range(150):
        shape = [2, 2] if k % 2 else [r.randint(0, 3) for _ in range(r.randint(0, 3))]
        rows.append([[[cell() for _ in range(n)] for n in shape] for _ in range(2)])
    t = "array<array<struct<text:string,colspan:int,rowspan:int>>>"
    got = spark.createDataFrame(rows, f"a {t}, b {t}").select(T.cell_by_cell(F.col("a"), F.col("b")), T.tree_distance(F.col("a"), F.col("b"))).collect()
    assert all(x is None or abs(x - y) < 1e-9 for x, y in got)
    assert all(x is not None for x, _ in got[1::2]) and sum(x is not None for x, _ in got) > 80


def test_f7_plain_tables_are_read_without_the_parser(spark):
    from scholia.functions import tables as T

    texts = ["<table><tr><td>1</td><td>a\nb</td></tr><tr></tr></table>", "<table></table>", "<table><tr><td>a&amp;b</td></tr></table>", "<p>x</p>", None, "<table><tr><td>1</td></tr></table>\n"]
    got = spark.createDataFrame([(x,) for x in texts], "h string").select(T.page_tables(F.col("h")).alias("t")).collect()
    assert [[[[tuple(c) for c in row] for row in t] for t in x.t] for x in got] == [T.parse_tables(x or "") for x in texts]


def test_f10_equal_page_texts_need_no_distance(spark):
    from scholia.operators.evaluate import page_ned

    rows = spark.createDataFrame([("A b.", "ab"), ("a, b", "a b"), (None, ""), ("x", None)], "a string, b string")
    out = rows.select(page_ned(F.col("a"), F.col("b")).alias("n"))
    # each text is normalised once
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[^A-Za-z0-9]+") == 2
    assert [x.n for x in out.collect()] == [0.5, 0.0, 0.0, 1.0]
