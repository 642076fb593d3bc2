from collections import Counter

from scholia.llm.quality_rules import RULES, Rule, quality_rules, verdict
from tests.llm.helpers import WORD, words


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 5)}
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


CASES = ["", None, " \n\t", "one two", "a b c d e a b c d e", "x " * 50, "#*$ %& |<>", "the of and " * 20, "line one here\nline one here\n\n  \nline one here", "é ü ñ" * 9, "a b c d e f a b c d e g a b c d e", "\r\nq\r\nq\r\n"]


def test_measures_against_brute_force(spark):
    rows = list(enumerate(CASES + [" ".join(words(200, 1) * 2), "the " + " of ".join(words(300, 2))]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in quality_rules(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_rules_name_what_fails(spark):
    ok = "the " + " of ".join(words(40, 3))
    rows = [(1, ok), (2, " ".join(words(40, 4))), (3, ok.replace(" of ", " of ### ")), (None, ok)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[None].kept
    assert got[2].failed_rules == ["stop_word_share"] and "symbols_per_word" in got[3].failed_rules


def test_table_is_a_parameter(spark):
    df = spark.createDataFrame([(1, " ".join(words(40, 4)))], "doc_id long, text string")
    assert quality_rules(df, (Rule("all", "n_words", 0, None),)).first().kept
    assert len(verdict(RULES)) == 3


def test_empty_and_clashing_columns(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b", 99, True, "w")], "doc_id long, text string, n_words int, kept boolean, other string")
    r = quality_rules(df).first()
    assert (r.n_words, r.kept, r.other) == (2, False, "w")
    df = spark.createDataFrame([(1, "a b", "t", "w", "h", "l", "u")], "doc_id long, text string, _text string, _words string, _Hashes string, _lines string, __text string")
    r = quality_rules(df).first()
    assert (r._text, r._words, r._Hashes, r._lines, r["__text"], r.n_words) == ("t", "w", "h", "l", "u", 2)


def test_no_python_in_the_plan(spark):
    plan = quality_rules(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
