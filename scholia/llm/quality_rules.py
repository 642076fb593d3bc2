"""Quality rules: a threshold table compiled into one Spark projection, with no user function."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in a is that for be with on as it was by are this "
    "de la le les et des en un une du que qui pour dans est par sur "
    "el los las y del se con una der die das und den von zu mit ist im auf nicht"
).split()
#: As they begin a sentence, too; lower-casing every word would cost more than the test.
CASED = [x for word in STOP_WORDS for x in (word, word.capitalize())]


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= ratio <= high; None leaves that side open."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: The default table; ratios are SQL expressions over the measures of `measures`.
RULES = (
    Rule("mean_word_chars", "word_chars / n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.1),
    # two more, as a short text may have none by chance
    Rule("stop_word_share", "(n_stop_words + 2) / n_words", 0.06, None),
    Rule("duplicate_line_share", "n_dup_lines / greatest(n_lines, 1)", None, 0.4),
    Rule("lines_per_word", "n_lines / n_words", None, 0.5),
)

MIN_WORDS = 10
#: Per cent of the words that may lie in repeated five-word windows.
MAX_REPEAT = 20


def _bound(value: Column, use) -> Column:
    """Evaluate `value` once per row and let `use` build an expression of it."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by five-word windows that occur at least twice; hashes are those of the windows.

    The rows whose windows are all distinct stop at the first test.  In the others equal
    windows are neighbours once sorted, and covered words are counted along the sorted
    positions of repeated windows.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = _bound(
        pairs,
        lambda s: F.transform(
            F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        ),
    )
    covered = _bound(
        F.sort_array(again),
        lambda p: F.when(
            F.size(p) > 0,
            F.aggregate(F.zip_with(F.slice(p, 2, F.size(p)), p, lambda b, a: F.coalesce(F.least(F.lit(5), b - a), F.lit(5))), F.lit(0), lambda acc, x: acc + x),
        ).otherwise(0),
    )
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(covered)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words, all long.

    Words are maximal runs without space or the characters 9 to 13; null counts as an
    empty text and every measure is then 0.  n_lines counts the lines that have a word,
    n_dup_lines those of them that equal an earlier line.  Existing columns of these
    names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    taken = {c.lower() for c in docs.columns}
    mark = "_"
    while any(mark + x in taken for x in ("text", "words", "hashes", "lines")):
        mark += "_"
    t, ws, hs, ls = (mark + x for x in ("text", "words", "hashes", "lines"))
    rows = docs.withColumn(t, text).withColumn(ws, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    w = F.col(ws)
    window = F.when(
        F.size(w) >= 5,
        F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4))),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn(hs, window).withColumn(ls, F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    lines = F.col(ls)
    return rows.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(w, F.col(hs)).cast("long"),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(CASED))).cast("long"),
        }
    ).drop(t, ws, hs, ls)


def verdict(rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> tuple[Column, Column, Column]:
    """base_failed, kept and the names of broken rules, from the measures' columns."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    broken = []
    for r in rules:
        ratio = F.expr(r.ratio)
        parts = [ratio < r.low] * (r.low is not None) + [ratio > r.high] * (r.high is not None)
        bad = parts[0] if len(parts) == 1 else parts[0] | parts[1]
        broken.append(F.when(bad, F.lit(r.name)))
    # the ratios of an unworded text would divide by zero; the base has failed it already
    names = F.when(base, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*broken)))
    return base, ~base & (F.size(names) == 0), names


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with the measures, base_failed, kept and failed_rules.

    The base fails texts of fewer than 10 words, null and empty ones too, and those with
    more than a fifth of their words in repeated five-word windows.  The table's rules
    judge the others.  Repeated rows are judged one by one; a null id changes nothing.
    """
    base, kept, names = verdict(rules)
    return measures(docs, text_col).withColumns({"base_failed": base, "failed_rules": names, "kept": kept})
