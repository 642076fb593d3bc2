"""Whether a chunk is worth indexing, and gates on converted documents."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.text import SLICE, non_space_length, plain_words, trimmed


def _most_of_one_char(dense: str) -> int:
    """How often the most frequent character occurs; work and memory follow the length."""
    if not dense:
        return 0
    codes = np.frombuffer(dense.encode(), np.uint8) if dense.isascii() else np.frombuffer(dense.encode("utf-32-le"), np.uint32)
    if codes.dtype == np.uint8 or codes.max() < 4 * len(codes) + 1024:
        return int(np.bincount(codes).max())
    return int(np.unique(codes, return_counts=True)[1].max())


def _ngram_share(w: list[str], different: int, n: int = 4) -> float:
    """The share of the n-gram that most windows hold, where it holds more than half; else at most a half.

    Windows that agree begin with the same word, so only texts whose words repeat that much are counted.
    """
    windows = len(w) - n + 1
    if len(w) < 2 * n or 2 * (len(w) - different + 1) <= windows or 2 * max(Counter(w).values()) <= windows:
        return 0.0
    return max(Counter(zip(*[w[k:] for k in range(n)])).values()) / windows


def text_measures(text: str) -> tuple[int, float, float, float]:
    """(non_ws, char_share, diversity, ngram_share) of a text; the share of a character is counted of the trimmed text's bytes."""
    w = plain_words(text)
    if not w:
        return 0, 0.0, 1.0, 0.0
    dense, different = "".join(w), len(set(w))
    begin = text.index(w[0])
    size = len(text[begin : text.rindex(w[-1]) + len(w[-1])].encode())
    return len(dense), _most_of_one_char(dense) / size, different / len(w) if len(w) >= 20 else 1.0, _ngram_share(w, different)


_MEASURES = T.StructType([T.StructField("non_ws", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("char_share", "diversity", "ngram_share")]])


@F.arrow_udf(_MEASURES)
def measures(texts: pa.Array) -> pa.Array:
    rows = (text_measures(t) for i in range(0, len(texts), SLICE) for t in texts.slice(i, SLICE).to_pylist())
    columns = list(zip(*rows)) or [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, pa.float64() if k else pa.int32()) for k, c in enumerate(columns)], names=_MEASURES.names)


def with_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds non_ws, char_share, diversity, ngram_share and reject_reason (null for a good text).

    The reasons in order: fewer than 50 characters; one character above 30 %; of 20 words
    or more less than 10 % different; one four-gram above 50 %.  A null text is empty.
    """
    names = ("non_ws", "char_share", "diversity", "ngram_share", "reject_reason")
    text = F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit("")))
    # through a generator: a filter on the reason would otherwise be pushed down, and all of this worked out once more for each use
    rows = df.drop(*names).withColumn("_q", measures(text)).select("*", F.inline(F.array("_q")))
    reason = (
        F.when(F.col("non_ws") < 50, "too_short").when(F.col("char_share") > 0.30, "dominant_char").when(F.col("diversity") < 0.10, "low_diversity").when(F.col("ngram_share") > 0.50, "dominant_ngram")
    )
    return rows.withColumn("reject_reason", reason).drop("_q")


def reason_text(df: DataFrame) -> Column:
    """The reason as a sentence, from with_quality's columns."""
    return (
        F.when(F.col("reject_reason") == "too_short", F.format_string("too short (%d non-whitespace chars)", "non_ws"))
        .when(F.col("reject_reason") == "dominant_char", F.format_string("one character is %.0f%% of the text", F.col("char_share") * 100))
        .when(F.col("reject_reason") == "low_diversity", F.format_string("only %.0f%% of the words differ", F.col("diversity") * 100))
        .when(F.col("reject_reason") == "dominant_ngram", F.format_string("one 4-gram is %.0f%% of the text", F.col("ngram_share") * 100))
    )


def quality_tally(df: DataFrame) -> DataFrame:
    """Accepted chunks and each reason's, from with_quality's rows."""
    named = lambda r: F.count_if(F.col("reject_reason") == r).alias(r)
    return df.agg(F.count_if(F.col("reject_reason").isNull()).alias("accepted"), *map(named, ("too_short", "dominant_char", "low_diversity", "dominant_ngram")))


def is_stub(pages: Column, markdown: Column, duration: Column) -> Column:
    """One page with fewer than 500 characters or converted within a second; a null duration skips that rule."""
    return (pages <= 1) & ((non_space_length(markdown) < 500) | F.coalesce(duration < 1.0, F.lit(False)))


def qc_verdict(truncations: Column, pages: Column) -> Column:
    """reject_loop for more than 20 repetition sites, or more than five a page."""
    return F.when((truncations > 20) | (truncations > 5 * F.greatest(pages, F.lit(1))), "reject_loop").otherwise("accept")


def is_html(content: Column) -> Column:
    """An HTML marker in the first 512 characters."""
    head = F.lower(F.substring(content, 1, 512))
    return F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype html"))


def is_pdf(content: Column) -> Column:
    """At least 100 bytes that begin as a PDF does."""
    return (F.octet_length(content) >= 100) & (F.substring(content, 1, 4).cast("string") == "%PDF")


#: Words of pages that stand in for an article.
LOGIN = ["sign in", "log in", "access denied", "403 forbidden", "subscription required", "purchase this article", "institutional access"]
WAITING = ["preparing to download", "hhs vulnerability disclosure", "please wait while the document loads"]
JOURNAL = ["impact factor", "citescore", "aims and scope"]
LANDING = ["clinical trials", "browse collections", "search results", "cookie policy"]
#: Phrases of loading pages, and one that counts only on a page of fewer bytes.
LOADING = ["preparing to download", "please wait while the document loads"]
DISCLOSURE, SHORT_PAGE = "hhs vulnerability disclosure", 2000


def _any(text: Column, *phrases: str) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def is_paywall(html: Column) -> Column:
    """Login walls, empty landing pages and other pages without the article."""
    low = F.lower(html)
    login = _any(low, *LOGIN)
    article = F.contains(low, F.lit("<article")) | (F.contains(low, F.lit("abstract")) & F.contains(low, F.lit("references")))
    visible = F.octet_length(trimmed(F.regexp_replace(low, r"<[^>]*(>|$)|>", "")))
    waiting = _any(low, *WAITING)
    journal = _any(low, *JOURNAL)
    landing = _any(low, *LANDING)
    return (login & (F.octet_length(html) < 100_000)) | (login & ~article) | ((visible < 500) & ~article) | waiting | ((journal | landing) & ~article)


def is_local_page(server: Column, pages: Column) -> Column:
    """A local HTML conversion of one page."""
    return (server == "local-html") & (pages <= 1)


def is_junk_html(server: Column, pages: Column, markdown: Column, reject_reason: Column) -> Column:
    """A local HTML conversion of one page with low quality or a loading page's words."""
    low = F.lower(markdown)
    stub = _any(low, *LOADING) | (F.contains(low, F.lit(DISCLOSURE)) & (F.octet_length(markdown) < SHORT_PAGE))
    return is_local_page(server, pages) & (reject_reason.isNotNull() | stub)
