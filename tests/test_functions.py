from datetime import date

import pytest
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.functions.dates import DateFilter, day_after, year_condition
from scholia.functions.html import to_markdown
from scholia.functions.repetition import clean_repetitions, cleaned, divergence_snippet, looping


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,after,before",
    [(">=2020", date(2020, 1, 1), None), (">2020", date(2021, 1, 1), None), ("<=2020-02", None, date(2020, 3, 1)), ("<2020-12-31", None, date(2020, 12, 31)), (">=2019 <2020-06", date(2019, 1, 1), date(2020, 6, 1)), (">2020-12", date(2021, 1, 1), None)],
)
def test_date_filters(text, after, before):
    assert DateFilter.parse(text) == DateFilter(after, before)


@pytest.mark.parametrize("text", ["", "2020-2024", ">=2020 >=2021", ">=2021 <2020", ">=20x", "2020"])
def test_bad_date_filters(text):
    with pytest.raises(ValueError):
        DateFilter.parse(text)


def test_leap_years():
    assert day_after("2024-02-29") == date(2024, 3, 1) and day_after("2024-02") == date(2024, 3, 1)


def test_years(spark):
    df = spark.createDataFrame([(2019,), (2020,), (None,)], "y int")
    assert df.where(year_condition(">=2020", "y")).count() == 1 and df.where(year_condition("2019", "y")).count() == 1
    assert year_condition("x", "y") is None


@pytest.mark.parametrize(
    "value,want",
    [("2024-05-01", 2024), ("1999", 1999), ("2025-01-01", 2025), ("2041", None), ("9999", None), ("1899", None), ("0001", None), (None, None), ("", None), ("XX", None), ("nope", None)],
)
def test_sane_year(spark, value, want):
    assert one(spark, T.sane_year("v", 2024), v=value) == want


@pytest.mark.parametrize(
    "value,want",
    [("10.48550/arXiv.2401.1", "2401.1"), ("10.48550/ARXIV.x", "x"), ("10.1/x", None), ("10.48550/arXiv.", None), ("10.48550/arXivx", None)],
)
def test_arxiv_doi(spark, value, want):
    assert one(spark, T.arxiv_id_of_doi("v"), v=value) == want


def test_small_texts(spark):
    assert one(spark, T.normalized_doi("v"), v="https://doi.org/10.1/AbC") == "10.1/abc"
    assert one(spark, T.normalized_doi("v"), v="HTTPS://doi.org/10.1/A") == "https://doi.org/10.1/a"
    assert one(spark, T.normalized_title("v"), v="The  Élan of a Test: part-2!") == "élan of test part2"
    assert one(spark, T.similarity("a", "b"), a="", b="") == 1.0
    assert one(spark, T.similarity("a", "b"), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert one(spark, T.percent_decoded("v"), v="a%20b+c") == "a b+c" and one(spark, T.percent_decoded("v"), v="%zz") == "%zz"
    assert one(spark, T.without_tags("v"), v="a<b>c</b> > d<e") == "ac  d"
    assert one(spark, T.title_of_markdown("v"), v="\n \n## A title \nx") == "A title"
    assert one(spark, T.first_year("v"), v="x 1850 y 2019-01 1999") == "2019"
    assert one(spark, T.sharded_key("v", "md", "p"), v="abc") == "p/ab/abc.md"
    assert one(spark, T.file_name("v"), v="10.1/a:b") == "10.1_a_b"
    assert one(spark, T.collapsed_digits("v"), v="0. 4 and 1 .5") == "0.4 and 1.5"
    assert one(spark, T.bytes_text("v"), v="1500000") == "1.5 MB"
    assert one(spark, T.looks_like_doi("v"), v="10.1/x") and not one(spark, T.looks_like_doi("v"), v="11.1/x")
    assert one(spark, T.looks_like_arxiv_id("v"), v="2401.01234v2") and not one(spark, T.looks_like_arxiv_id("v"), v="240.1")


@pytest.mark.parametrize("value,want", [("one", "one"), ("two words", '"two words"'), ("a AND b", "a AND b"), ('"x y"', '"x y"')])
def test_phrases(value, want):
    assert T.quoted_phrase(value) == want


def test_inverted_abstract(spark):
    df = spark.createDataFrame([({"to": [0, 4], "be": [1, 5], "or": [2], "not": [3]},), ({},), ({"x": [2]},)], "m map<string,array<int>>")
    assert [r[0] for r in df.select(T.inverted_abstract("m")).collect()] == ["to be or not to be", "", "  x"]


def test_page_offsets(spark):
    md = "ab\n\n---\n\ncdé\n\n---\n\n"
    got = one(spark, T.page_offsets("v"), v=md)
    assert [tuple(p) for p in got] == [(1, 0, 2), (2, 9, 13), (3, 20, 20)]
    assert one(spark, T.page("v", 2), v=md) == "cdé" and one(spark, T.page("v", 9), v=md) is None


def test_relevance(spark):
    rel = T.relevance("deep nets", "t", "a", "d", "d")
    assert one(spark, rel, t="Deep nets", a="about", d="x") == pytest.approx(0.4 + 0.3 + 0.2 + 0.1)
    assert one(spark, rel, t="other", a="deep nets", d=None) == pytest.approx(0.4 + 0.15 + 0.05)
    assert one(spark, T.relevance(" ", "t", "a", "d", "d"), t="x", a="y", d="z") == 0.0


@pytest.mark.parametrize(
    "text,want,sites",
    [("a " * 7, "a", 1), ("a a a a a", "a a a a a", 0), ("x y x y x y x y x y", "x y", 1), ("one two three four " * 4, "one two three four", 1), ("keep  this\nand this", "keep this\nand this", 0), ("P, P, P, P, P, P, end", "P, end", 1)],
)
def test_word_loops(spark, text, want, sites):
    assert tuple(one(spark, cleaned(F.col("v")), v=text)) == (want, sites)


def plain_loops(text):
    """The passes over word units, word by word."""
    sites = 0
    for n, most in ((4, 3), (2, 4), (1, 5)):
        lines = []
        for line in text.split("\n"):
            w, out, i = line.split(), [], 0
            while i < len(w):
                k = 1
                while i + n <= len(w) and w[i : i + n] == w[i + k * n : i + (k + 1) * n]:
                    k += 1
                if k > most:
                    out, i, sites = out + w[i : i + n], i + k * n, sites + 1
                else:
                    out, i = [*out, w[i]], i + 1
            lines.append(line if len(w) < 2 * n else " ".join(out))
        text = "\n".join(lines)
    return text, sites


def test_word_loops_of_random_texts(spark):
    import random

    r = random.Random(3)
    texts = ["".join(r.choice(["a", "a", "b", "ab", "é", ",", "a b", " "]) + r.choice([" ", " ", " ", "  ", "\t", "\n", "\u00a0"]) for _ in range(r.randint(0, 60))) for _ in range(500)]
    texts += [" x " * 7, " lone \n two words ", "a b " * 3000, ("w" + " q" * 4 + "\n") * 5]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").select("i", cleaned(F.col("v")).alias("c")).collect()
    assert {x.i: tuple(x.c) for x in got} == {i: plain_loops(t) for i, t in enumerate(texts)}


def test_snippets_of_loops(spark):
    long = "".join(chr(97 + i % 23) for i in range(200))
    rows = [(1, long + " z" * 9 + " end"), (2, "fine"), (3, None), (4, "y" * 12)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: (r.sites, r.snippet) for r in looping(df, 0, "doc_id", "text").collect()}
    assert set(got) == {1, 4} and got[4] == (1, "y" * 12)
    # the first difference is where the second z was, and 60 characters stand on each side of it
    at = len(long) + 3
    assert got[1] == (1, rows[0][1][at - 60 : at + 60])
    assert one(spark, divergence_snippet(F.col("a"), F.col("b")), a="same", b="same") is None
    assert one(spark, divergence_snippet(F.col("a"), F.col("b")), a="abc", b="ab") == "abc"


def test_repetitions_count_all_passes(spark):
    df = spark.createDataFrame([("g" * 30 + " ok " + "z " * 9,), ("g" * 10,), (None,)], "v string")
    clean, sites = clean_repetitions(F.col("v"))
    assert [tuple(r) for r in df.select(clean, sites).collect()] == [("g ok z", 2), ("g" * 10, 0), (None, 0)]


@pytest.mark.parametrize(
    "html,want",
    [
        ("<body><nav>x</nav><article><h1>T</h1><p>one <b>two</b></p><script>no</script></article></body>", "# T\n\n\none**two**"),
        ("<body><p>a<p>b</body>", "a\n\n\nb"),
        ("<main><ul><li>x<li>y</ul></main>", "- x\n- y"),
        ("<div class='article-body'>in</div><div>out</div>", "in"),
        ("<body><table><tr><td>1</td><td>2</td></tr></table></body>", "1 | 2 |"),
        ("plain", "plain"),
        ("", ""),
    ],
)
def test_markdown(html, want):
    assert to_markdown(html) == want
