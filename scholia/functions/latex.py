"""LaTeX as plain text: commands as their letters and signs, fractions with a stroke, what groups hold at any depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.operators.evaluate import GREEK

#: Commands that stand for a sign.
SIGNS = {
    "times": "×", "cdot": "·", "cdots": "·", "ldots": "…", "dots": "…", "pm": "±", "mp": "∓", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠",
    "approx": "≈", "infty": "∞", "sum": "∑", "prod": "∏", "int": "∫", "partial": "∂", "rightarrow": "→", "to": "→", "leftarrow": "←", "in": "∈", "nabla": "∇", "quad": " ", "qquad": " ",
}

# commands; escaped characters; groups, of scripts too; bare scripts with the one character that they take; other text
_TOKEN = r"\\\p{IsAlphabetic}+|\\[\s\S]|[_^]?\{|[}$]|[_^][\s\S]|[^\\{}_^$]+|[\s\S]"


def plain_latex(text: Column) -> Column:
    """The text without delimiters, commands and braces; \\frac{a}{b} is a/b.

    Commands of a letter or sign become it, others go, and what their groups hold stays.
    Escaped characters go.  A bare script keeps the one character behind it, a backslash
    too.  One fold over the tokens with a stack of open groups, so depth has no bound; groups
    that are never closed end with the text.
    """
    known = F.create_map(*[F.lit(x) for letter, name in GREEK.items() for x in ("\\" + name, letter)], *[F.lit(x) for name, sign in SIGNS.items() for x in ("\\" + name, sign)])
    none = F.array().cast("array<string>")

    def step(acc: Column, t: Column) -> Column:
        open_ = acc["open"]
        begins, ends = t.rlike(r"^[_^]?\{$"), t == "}"
        said = (
            F.when(begins | (t == "$"), "")
            .when(ends, F.when((F.size(open_) > 0) & (F.try_element_at(open_, F.lit(-1)) == "over"), "/").otherwise(""))
            .when(t.rlike(r"^\\\p{IsAlphabetic}"), F.coalesce(F.try_element_at(known, t), F.lit("")))
            .when(t.rlike(r"^\\[\s\S]"), "")
            .when(t.rlike(r"^[_^][\s\S]"), F.substring(t, 2, 1))
            .otherwise(t)
        )
        opened = F.when(begins, F.concat(open_, F.array(acc["next"]))).when(ends & (F.size(open_) > 0), F.slice(open_, 1, F.size(open_) - 1)).otherwise(open_)
        return F.struct(F.concat(acc["parts"], F.array(said)).alias("parts"), opened.alias("open"), F.when(t == "\\frac", "over").otherwise("").alias("next"))

    start = F.struct(none.alias("parts"), none.alias("open"), F.lit("").alias("next"))
    unclosed = lambda acc: F.repeat(F.lit("/"), F.size(F.filter(acc["open"], lambda x: x == "over")))
    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), unclosed(acc)))
