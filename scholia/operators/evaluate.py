"""Scores of extracted text, formulas and tables against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from scholia.functions.tables import canonical_table, page_tables, pair_score
from scholia.functions.text import words

#: Greek letters and their commands.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu",
    "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega", "Γ": "Gamma", "Δ": "Delta",
    "Θ": "Theta", "Λ": "Lambda", "Π": "Pi", "Σ": "Sigma", "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega",
}
#: Formatting commands without meaning for a comparison, in the order in which they go.
FILTERED = [
    "mathbf", "mathrm", "mathnormal", "mathit", "mathbb", "mathcal", "mathscr", "mathfrak", "mathsf", "mathtt", "textbf", "text", "boldmath", "boldsymbol",
    "operatorname", "bm", "symbfit", "mathbfcal", "symbf", "scriptscriptstyle", "notag", "setlength", "coloneqq", "space", "thickspace", "thinspace", "medspace",
    "nobreakspace", "negmedspace", "quad", "qquad", "enspace", "substackw", "left", "right", "displaystyle",
]


def ned(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length in bytes; 0 for two empty texts."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), longest), F.lit(0.0))


#: Characters that become letters or digits for a comparison.
FOLDED = {
    "×": "x", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae", "°": "deg", "℃": "degC", "¼": "14", "½": "12", "¾": "34", "²": "2", "³": "3", "¹": "1",
}


def normalized_text(text: Column) -> Column:
    """Letters and digits of a page's text, as they are compared: without markup, LaTeX commands, punctuation and space.

    Greek commands become their letters and \\times an x; other commands go and what they
    hold stays, while an escaped character goes, and so do tags, an unterminated one to the
    end of its line.  Everything else that marks headings, emphasis and tables is no letter.
    """
    text = F.coalesce(text, F.lit(""))
    # ASCII without commands and tags has nothing of all that
    return F.when(text.rlike(r"[^\x00-\x7F]|[\\<]"), _without_marks(text)).otherwise(F.regexp_replace(text, r"[^A-Za-z0-9]+", ""))


def _without_marks(text: Column) -> Column:
    # of a command right behind a bare _ or ^ only the backslash is taken, so its letters stay
    s = F.regexp_replace(text, r"(?s)\\\P{IsAlphabetic}|[_^]\\", "")
    for letter, name in GREEK.items():
        s = F.regexp_replace(s, rf"\\{name}(?!\p{{IsAlphabetic}})", letter)
    s = F.regexp_replace(F.regexp_replace(s, r"\\times(?!\p{IsAlphabetic})", "x"), r"\\\p{IsAlphabetic}+", "")
    s = F.regexp_replace(s, r"<[^>\n]*(?:>|(?=\n)|$)", "")
    for c, to in FOLDED.items():
        s = F.replace(s, F.lit(c), F.lit(to))
    return F.regexp_replace(s, r"[^\p{IsAlphabetic}\p{N}]+", "")


def page_ned(a: Column, b: Column) -> Column:
    """NED of the normalized texts, each of which is worked out once; equal ones need no comparison."""
    pair = F.array(F.struct(normalized_text(a).alias("a"), normalized_text(b).alias("b")))
    return F.get(F.transform(pair, lambda p: F.when(p["a"] == p["b"], F.lit(0.0)).otherwise(ned(p["a"], p["b"]))), F.lit(0))


def text_score(a: Column, b: Column) -> Column:
    return (1 - page_ned(a, b)) * 100


def _grams(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def common_count(a: Column, b: Column) -> Column:
    """The size of the multiset intersection of two arrays, in one walk over both, sorted together."""
    marked = F.sort_array(F.concat(F.transform(a, lambda x: F.struct(x.alias("x"), F.lit(0).alias("side"))), F.transform(b, lambda x: F.struct(x.alias("x"), F.lit(1).alias("side")))))

    def step(acc: Column, item: Column) -> Column:
        # of equal tokens those of a come first; each of b uses one of them up
        left = F.when(acc["x"] == item["x"], acc["left"]).otherwise(F.lit(0))
        used = (item["side"] == 1) & (left > 0)
        return F.struct(item["x"].alias("x"), F.when(item["side"] == 0, left + 1).when(used, left - 1).otherwise(F.lit(0)).alias("left"), (acc["n"] + used.cast("int")).alias("n"))

    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("left"), F.lit(0).alias("n"))
    return F.aggregate(marked, start, step, lambda acc: acc["n"])


def bleu4(ref: Column, hyp: Column) -> Column:
    """BLEU-4 on lower-case words: the geometric mean of clipped precisions, times the brevity penalty; any zero gives 0."""
    pair = F.array(F.struct(words(F.lower(ref)).alias("r"), words(F.lower(hyp)).alias("h")))
    return F.get(F.transform(pair, lambda p: _bleu(p["r"], p["h"])), F.lit(0))


def _bleu(r: Column, h: Column) -> Column:
    logs, zero = F.lit(0.0), F.lit(False)
    for n in range(1, 5):
        p = F.coalesce(F.try_divide(common_count(_grams(h, n), _grams(r, n)).cast("double"), F.size(_grams(h, n))), F.lit(0.0))
        zero = zero | (p == 0)
        logs = logs + F.log(F.greatest(p, F.lit(1e-300))) / 4
    short = F.when(F.size(h) >= F.size(r), F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.size(r).cast("double"), F.size(h))))
    return F.when((F.size(r) == 0) | (F.size(h) == 0) | zero, F.lit(0.0)).otherwise(F.exp(logs) * short)


def normalized_formula(latex: Column) -> Column:
    """LaTeX without delimiters, layout and font commands and spaces, in lower case."""
    s = F.regexp_replace(F.trim(latex), r"^\$+|\$+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^\n+|\n+$", ""), "\u0120", "")
    for letter, name in GREEK.items():
        s = F.replace(s, F.lit(letter), F.lit("\\" + name))
    s = F.regexp_replace(s, r"(?s)^\s*\\\[(.*)\\\]\s*$", "$1")
    s = F.regexp_replace(s, r"\\(?:tag|hspace|begin|end)\*?\{[^{}]*\}", "")
    s = F.regexp_replace(s, r"\.+$", "")
    for name in FILTERED:
        s = F.replace(s, F.lit("\\" + name), F.lit(""))
    return F.lower(F.replace(F.replace(s, F.lit(" "), F.lit("")), F.lit("$$"), F.lit("")))


def cdm(ref: Column, hyp: Column) -> Column:
    """F1 of the token multisets of two formulas, 0 to 100."""
    r, h = normalized_formula(ref), normalized_formula(hyp)
    tok = lambda s: F.regexp_extract_all(s, F.lit(r"\\\p{L}+|[0-9]+|\S"), F.lit(0))
    f1 = 200.0 * common_count(tok(r), tok(h)) / (F.size(tok(r)) + F.size(tok(h)))
    return F.when((r == "") & (h == ""), F.lit(100.0)).when((r == "") | (h == ""), F.lit(0.0)).otherwise(F.least(f1, F.lit(100.0)))


def best_pairs_total(pairs: Column) -> Column:
    """The sum of the scores of pairs struct(s, i, j), s being the negative score: the best pair first, each i and j once."""

    def take(acc: Column, p: Column) -> Column:
        free = ~F.array_contains(acc["i"], p["i"]) & ~F.array_contains(acc["j"], p["j"])
        return F.struct(
            F.when(free, F.concat(acc["i"], F.array(p["i"]))).otherwise(acc["i"]).alias("i"),
            F.when(free, F.concat(acc["j"], F.array(p["j"]))).otherwise(acc["j"]).alias("j"),
            F.when(free, acc["total"] - p["s"]).otherwise(acc["total"]).alias("total"),
        )

    none = F.array().cast("array<int>")
    return F.aggregate(F.sort_array(pairs), F.struct(none.alias("i"), none.alias("j"), F.lit(0.0).alias("total")), take, lambda acc: acc["total"])


def paired_scores(rows: DataFrame, ids: list[str], score, name: str) -> DataFrame:
    """ids and the mean score of the items of array _truth, each paired with one of _found, best pair first, in the column `name`.

    A true item without a partner counts 0, a found one without a partner nothing; a row
    without true items scores null.
    """
    rows = rows.withColumn("_n", F.size("_truth"))
    pairs = rows.select(*ids, "_n", "_found", F.posexplode_outer("_truth").alias("_i", "_a")).select(*ids, "_n", "_i", "_a", F.posexplode_outer("_found").alias("_j", "_b"))
    scored = pairs.select(*ids, "_n", F.struct((-score(F.col("_a"), F.col("_b"))).alias("s"), F.col("_i").alias("i"), F.col("_j").alias("j")).alias("p"))
    best = F.collect_list(F.when(F.col("p.i").isNotNull() & F.col("p.j").isNotNull(), F.col("p")))
    return scored.groupBy(*ids, "_n").agg(best.alias("_pairs")).select(*ids, F.when(F.col("_n") > 0, best_pairs_total(F.col("_pairs")) / F.col("_n")).alias(name))


def table_scores(pages: DataFrame, ids: list[str], truth: str = "truth", found: str = "found") -> DataFrame:
    """ids and teds: the mean score of the tables of each page's truth, each paired with one that was found, best pair first.

    ids name a page.  Cells are compared as normalized text.
    """
    cells = lambda t: F.transform(t, lambda row: F.transform(row, lambda c: F.struct(normalized_text(c["text"]).alias("text"), c["colspan"].alias("colspan"), c["rowspan"].alias("rowspan"))))
    tables = lambda c: F.transform(page_tables(canonical_table(F.col(c))), cells)
    return paired_scores(pages.select(*ids, tables(truth).alias("_truth"), tables(found).alias("_found")), ids, pair_score, "teds")


def formula_scores(pages: DataFrame, ids: list[str], truth: str = "truth", found: str = "found") -> DataFrame:
    """ids and cdm: the mean score of the formulas of each page's truth, each paired with one that was found, best pair first.

    truth and found are arrays of LaTeX texts; ids name a page.
    """
    none = F.array().cast("array<string>")
    rows = pages.select(*ids, *[F.array_compact(F.coalesce(F.col(c), none)).alias(n) for c, n in ((truth, "_truth"), (found, "_found"))])
    return paired_scores(rows, ids, cdm, "cdm")


def composite(text: Column, table: Column, formula: Column, has_text: Column) -> Column:
    """The mean of the scores that are there; text counts only if the truth has text or nothing else is there."""
    use_text = F.when(has_text | (table.isNull() & formula.isNull()), text)
    some = F.array_compact(F.array(use_text, table, formula))
    return F.coalesce(F.try_divide(F.aggregate(some, F.lit(0.0), lambda acc, x: acc + x), F.size(some)), F.lit(0.0))


def means(pages: DataFrame) -> DataFrame:
    """Means over pages with ned, bleu, composite, text, table and formula scores; a mean of nothing is 0.

    The overall score is a third of the sum of the three, whether or not each has pages.
    """
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    out = pages.agg(*[mean(c).alias(f"mean_{c}") for c in ("ned", "bleu", "composite", "text", "table", "formula")], F.count(F.lit(1)).alias("n_pages"))
    return out.withColumn("overall", (F.col("mean_text") + F.col("mean_table") + F.col("mean_formula")) / 3)


def scored_pages(pages: DataFrame) -> DataFrame:
    """pages (id, text, formula, tables; found_text, found_formula, found_tables) with ned, bleu, text, table, formula and composite scores.

    formula and found_formula are a LaTeX text or an array of them.  Tables and formulas
    score only where the truth has some.  A page that failed, whose found_text is null,
    scores ned 1, bleu and composite 0, and text 0 where the truth has text; it has no
    table, formula or other text score, and counts in none of their means.
    """
    failed = F.col("found_text").isNull()
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""

    def formulas(c: str) -> Column:
        if isinstance(pages.schema[c].dataType, ArrayType):
            return F.filter(F.col(c), has)
        return F.when(has(c), F.array(c)).otherwise(F.array().cast("array<string>"))

    tables = table_scores(pages.select("id", F.col("tables").alias("truth"), F.col("found_tables").alias("found")), ["id"])
    cdms = formula_scores(pages.select("id", formulas("formula").alias("truth"), formulas("found_formula").alias("found")), ["id"])
    compared = pages.select("*", F.explode(F.array(F.when(~failed, page_ned(F.col("text"), F.col("found_text"))))).alias("_ned"))
    rows = compared.join(tables, "id").join(cdms, "id")
    if_good = lambda score: F.when(~failed, score)
    out = rows.select(
        "id",
        F.when(failed, F.lit(1.0)).otherwise(F.col("_ned")).alias("ned"),
        F.when(failed, F.lit(0.0)).otherwise(bleu4(F.coalesce("text", F.lit("")), F.coalesce("found_text", F.lit("")))).alias("bleu"),
        F.when(failed, F.when(has("text"), 0.0)).otherwise((1 - F.col("_ned")) * 100).alias("score"),
        if_good(F.col("teds")).alias("table"),
        if_good(F.col("cdm")).alias("formula"),
        has("text").alias("has_text"),
        failed.alias("failed"),
    )
    whole = F.when(F.col("failed"), F.lit(0.0)).otherwise(composite(F.col("score"), F.col("table"), F.col("formula"), F.col("has_text")))
    return out.select("id", "failed", "ned", "bleu", F.col("score").alias("text"), "table", "formula", whole.alias("composite"))


def report(runs: DataFrame, dataset: str = "dataset") -> DataFrame:
    """The means of each dataset of scored pages, and of all of them as the row 'all'."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}")
    measures = [mean(c) for c in ("ned", "bleu", "composite", "text", "table", "formula")]
    return runs.rollup(dataset).agg(F.count(F.lit(1)).alias("n_pages"), *measures).withColumn(dataset, F.coalesce(dataset, F.lit("all")))
