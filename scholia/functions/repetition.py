"""Repetition loops in converted text: found, counted, cut to one occurrence and shown."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.text import SLICE, plain_words

#: Words of the repeated unit, and how often it may follow itself, in the order of the passes.
PASSES = ((4, 3), (2, 4), (1, 5))
#: How often a character may follow itself, and the characters of a snippet.
CHAR_RUN, SNIPPET = 10, 120

_CHARS = rf"(?s)(.)\1{{{CHAR_RUN},}}+"


def char_runs(text: Column) -> Column:
    """How often a character occurs more than ten times in a row."""
    return F.coalesce(F.regexp_count(text, F.lit(_CHARS)), F.lit(0))


def without_char_runs(text: Column) -> Column:
    return F.regexp_replace(text, _CHARS, "$1")


def _short_runs(text: str) -> tuple[str, int]:
    """The text with each run of a character cut to one, if it is too long, and how many there were."""
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    lengths = np.diff(starts, append=len(codes))
    long = lengths > CHAR_RUN
    if not text or not long.any():
        return text, 0
    # of a long run the first character stays
    kept = np.repeat(~long, lengths)
    kept[starts] = True
    return codes[kept].tobytes().decode("ascii" if text.isascii() else "utf-32-le"), int(long.sum())


def _cut(w: list[str], n: int, most: int) -> tuple[list[str], int]:
    """Words without loops of n words, and how many there were."""
    same = list(map(eq, w, w[n:]))
    # a loop is so many equal pairs in a row
    if sum(same) < n * most:
        return w, 0
    out, i, sites = [], 0, 0
    while i < len(w):
        k = i
        while k < len(same) and same[k] and k - i < n * most:
            k += 1
        if k - i < n * most:
            out.append(w[i])
            i += 1
            continue
        while k < len(same) and same[k]:
            k += 1
        out += w[i : i + n]
        i += n * ((k - i) // n + 1)
        sites += 1
    return out, sites


def plain_cleaned(text: str) -> tuple[str, int]:
    """cleaned of one text."""
    text, sites = _short_runs(text)
    lines = text.split("\n")
    for at, line in enumerate(lines):
        w = plain_words(line)
        if len(w) > 1:
            for unit in PASSES:
                w, found = _cut(w, *unit)
                sites += found
            lines[at] = " ".join(w)
    return "\n".join(lines), sites


_CLEAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("sites", T.IntegerType())])


@F.arrow_udf(_CLEAN)
def _cleaned(texts: pa.Array) -> pa.Array:
    parts = []
    for i in range(0, len(texts), SLICE):
        rows = [(None, 0) if t is None else plain_cleaned(t) for t in texts.slice(i, SLICE).to_pylist()]
        parts.append(pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32()))], names=_CLEAN.names))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("text", pa.string()), ("sites", pa.int32())]))


def cleaned(text: Column) -> Column:
    """struct(text, sites): the text with each loop cut to one occurrence, and the number of loops.

    Characters come first, then lines of two words or more get one space between words and
    none around them, then units of four words, of two and of one are cut, each pass on what
    the one before left.  A loop that begins further left is cut first, and what follows it
    is looked at anew.  A null text is null, with 0 sites.
    """
    return _cleaned(F.make_valid_utf8(text))


def clean_repetitions(text: Column) -> tuple[Column, Column]:
    """cleaned's text and sites as two columns."""
    state = cleaned(text)
    return state["text"], state["sites"]


def divergence_snippet(before: Column, after: Column, window: int = SNIPPET) -> Column:
    """So many characters around the first difference, of the text before; null for equal texts."""
    a, b = F.split(before, ""), F.split(after, "")
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.isNull() | y.isNull() | (x != y)), True)
    at = (first - 1).cast("int")
    begin = F.greatest(at - window // 2, F.lit(0))
    return F.when(before != after, F.substring(before, begin + 1, at + window // 2 - begin))


def looping(docs: DataFrame, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """id, sites and snippet of the documents with more than `threshold` loops."""
    state = F.explode(F.array(cleaned(F.col(text_col))))
    rows = docs.select(id_col, text_col, state.alias("_clean")).where(F.col("_clean.sites") > threshold)
    return rows.select(id_col, F.col("_clean.sites").alias("sites"), divergence_snippet(F.col(text_col), F.col("_clean.text")).alias("snippet"))
