"""Text expressions, all native columns, and words as Python's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.schemas import PAGE_SEPARATOR

ColumnOrName = Column | str

#: Unicode's white space, as a pattern; str.split also breaks at the four separators of ASCII, which are none.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD, _SEPARATOR = re.compile(f"[^{_SPACE}]+"), re.compile("[\x1c-\x1f]")
#: Texts that are Python's at one time.
SLICE = 256


def plain_words(text: str) -> list[str]:
    """Maximal runs without white space."""
    return _WORD.findall(text) if _SEPARATOR.search(text) else text.split()


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: ColumnOrName) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def words(x: ColumnOrName) -> Column:
    """Maximal runs without white space; an empty array for a null."""
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def non_space_length(x: ColumnOrName) -> Column:
    """Characters other than white space."""
    return F.length(F.regexp_replace(_c(x), r"(?U)\s+", ""))


def byte_length(x: ColumnOrName) -> Column:
    return F.octet_length(_c(x))


def normalized_doi(x: ColumnOrName) -> Column:
    """Without the resolver's address, in lower case; the address is only known in its exact case."""
    return F.lower(F.regexp_replace(_c(x), r"^https://doi\.org/", ""))


def normalized_title(x: ColumnOrName) -> Column:
    """Letters, digits and single spaces in lower case, without English articles."""
    plain = F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}\s]", "")
    return F.array_join(F.filter(words(plain), lambda w: ~w.isin("the", "a", "an")), " ")


def similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty texts."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.try_divide(F.levenshtein(a, b).cast("double"), longest))


def bounded_similarity(a: ColumnOrName, b: ColumnOrName, least: float) -> Column:
    """The similarity where it is at least so much, else null; the distance is given up beyond what that allows."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor(longest * F.lit(1 - least) + F.lit(1e-9)).cast("int")
    sim = F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.try_divide(F.call_function("levenshtein", a, b, most).cast("double"), longest))
    return F.when((F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0) & (sim >= least), sim)


def relevance(query: str, title: ColumnOrName, abstract: ColumnOrName, doi: ColumnOrName, date: ColumnOrName) -> Column:
    """How well a paper answers a query, 0 to 1: terms found, phrase, share of the title, completeness.

    Terms match as substrings.  A query of one term has its phrase looked for in the title only.
    """
    phrase = query.lower()
    terms = phrase.split()
    if not terms:
        return F.lit(0.0)
    t, a = F.lower(_c(title)), F.lower(F.coalesce(_c(abstract), F.lit("")))
    both = F.concat(t, F.lit(" "), a)
    hits = lambda text: sum((F.contains(text, F.lit(x)).cast("int") for x in terms), F.lit(0))
    in_title = F.contains(t, F.lit(phrase))
    said = F.when(in_title, F.lit(1.0))
    if len(terms) > 1:
        said = said.when(F.contains(a, F.lit(phrase)), F.lit(0.5))
    n = F.size(words(t))
    density = F.when(n > 0, hits(t) / n).otherwise(F.lit(0.0))
    known = _c(abstract).isNotNull().cast("double") * 0.5 + _c(doi).isNotNull().cast("double") * 0.25 + _c(date).isNotNull().cast("double") * 0.25
    return F.lit(0.4) * hits(both) / len(terms) + F.lit(0.3) * said.otherwise(F.lit(0.0)) + F.lit(0.2) * density + F.lit(0.1) * known


def arxiv_id_of_doi(x: ColumnOrName) -> Column:
    """What follows the arXiv prefix of a DOI, in any case; null for others."""
    return F.nullif(F.regexp_extract(_c(x), r"(?i)^10\.48550/arxiv\.(.+)$", 1), F.lit(""))


def looks_like_doi(x: ColumnOrName) -> Column:
    return _c(x).rlike(r"^10\..*/")


def looks_like_arxiv_id(x: ColumnOrName) -> Column:
    return _c(x).rlike(r"^\d{4}\.\d*(v.*)?$")


def quoted_phrase(query: str) -> str:
    """A query of several words in quotes, unless it has quotes or boolean operators."""
    parts = query.split()
    if len(parts) < 2 or '"' in query or any(op in query for op in (" AND ", " OR ", " NOT ")):
        return query
    return f'"{query}"'


def file_name(x: ColumnOrName) -> Column:
    """An id as a file name."""
    return F.translate(_c(x), "/\\:", "___")


def sharded_key(stem: ColumnOrName, extension: str, prefix: str = "") -> Column:
    """prefix/st/stem.extension, by the first two characters of the stem."""
    parts = [F.substring(_c(stem), 1, 2), F.concat(_c(stem), F.lit("." + extension))]
    return F.concat_ws("/", *([F.lit(prefix)] if prefix else []), *parts)


def percent_decoded(x: ColumnOrName) -> Column:
    """Percent escapes undone; a plus stays a plus, and a malformed text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(_c(x), F.lit("+"), F.lit("%2B"))), _c(x))


def pages_of(markdown: ColumnOrName) -> Column:
    """The pages of a markdown text."""
    return F.split(_c(markdown), r"\n\n---\n\n", -1)


def page(markdown: ColumnOrName, number: int) -> Column:
    """One page by its number from 1; null beyond the last."""
    return F.get(pages_of(markdown), F.lit(number - 1))


def page_offsets(markdown: ColumnOrName) -> Column:
    """array<struct(page, char_start, char_end)>: half-open byte ranges of the pages."""
    start = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<page:int,char_start:bigint,char_end:bigint>>")
    step = lambda acc, p: F.struct(
        (acc["at"] + F.octet_length(p) + len(PAGE_SEPARATOR)).alias("at"),
        F.concat(acc["out"], F.array(F.struct((F.size(acc["out"]) + 1).alias("page"), acc["at"].alias("char_start"), (acc["at"] + F.octet_length(p)).alias("char_end")))).alias("out"),
    )
    return F.aggregate(pages_of(markdown), F.struct(start.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def first_year(text: ColumnOrName) -> Column:
    """The first year 19xx or 20xx of the first 50 lines, as text; null without one."""
    head = F.array_join(F.slice(F.split(_c(text), "\n"), 1, 50), "\n")
    return F.nullif(F.regexp_extract(head, r"\b(?:19|20)\d{2}\b", 0), F.lit(""))


def sane_year(date: ColumnOrName, this_year: int) -> Column:
    """The leading year of a date text if it lies between 1900 and next year."""
    y = F.substring(_c(date), 1, 4).try_cast("bigint")
    return F.when(y.between(1900, this_year + 1), y)


def title_of_markdown(markdown: ColumnOrName) -> Column:
    """The first line that isn't blank, without heading marks."""
    first = F.get(F.filter(F.split(_c(markdown), "\n"), lambda x: trimmed(x) != ""), F.lit(0))
    return trimmed(F.regexp_replace(trimmed(first), r"^#+", ""))


def without_tags(x: ColumnOrName) -> Column:
    """Tags dropped, an unterminated one to the end; stray closing brackets go too."""
    return F.regexp_replace(_c(x), r"<[^>]*(>|$)|>", "")


def inverted_abstract(index: ColumnOrName) -> Column:
    """The text of a map from word to its positions; a gap is an empty word."""
    pairs = F.flatten(F.transform(F.map_entries(_c(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    size = F.array_max(F.transform(pairs, lambda x: x["p"])) + 1
    byplace = F.map_from_entries(pairs)
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.try_element_at(byplace, i), F.lit(""))), " ")).otherwise("")


def collapsed_digits(x: ColumnOrName) -> Column:
    """'0. 4' and '0 .4' become '0.4'."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"(\d)\. +(?=\d)", "$1."), r"(\d) +\.(?=\d)", "$1.")


def bytes_text(n: ColumnOrName) -> Column:
    """A size in decimal units with one digit behind the point; halves are rounded up."""
    n = _c(n).cast("double")
    return (
        F.when(n >= 1e9, F.format_string("%.1f GB", n / 1e9))
        .when(n >= 1e6, F.format_string("%.1f MB", n / 1e6))
        .when(n >= 1e3, F.format_string("%.1f KB", n / 1e3))
        .otherwise(F.format_string("%.0f B", n))
    )


def age_text(seconds: ColumnOrName) -> Column:
    """A time ago in its largest whole unit."""
    s = _c(seconds).cast("long")
    unit = lambda n, name: F.concat(F.call_function("div", s, F.lit(n)).cast("string"), F.lit(name + " ago"))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def author_names(authors: ColumnOrName) -> Column:
    """The names of authors, joined by commas."""
    return F.array_join(F.transform(_c(authors), lambda a: a["name"]), ", ")


def table_html(tokens: ColumnOrName, cells: ColumnOrName) -> Column:
    """A table of structure tokens, with the texts of its cells in order; a cell without a text is empty.

    A cell begins with the token of an empty cell, or with the end of a tag that was left
    open for its spans.
    """
    t, texts = _c(tokens), _c(cells)
    fill = lambda n: F.coalesce(F.get(texts, n), F.lit(""))
    whole, opened = F.lit("<td></td>"), F.lit(">")
    step = lambda acc, x: F.struct(
        F.concat(acc["html"], F.when(x == whole, F.concat(F.lit("<td>"), fill(acc["n"]), F.lit("</td>"))).when(x == opened, F.concat(F.lit(">"), fill(acc["n"]))).otherwise(x)).alias("html"),
        (acc["n"] + ((x == whole) | (x == opened)).cast("int")).alias("n"),
    )
    start = F.struct(F.lit("<table>").alias("html"), F.lit(0).alias("n"))
    return F.aggregate(t, start, step, lambda acc: F.concat(acc["html"], F.lit("</table>")))


def downscaled(width: ColumnOrName, height: ColumnOrName, most: int) -> Column:
    """struct(width, height) of an image whose longer side has at most so many pixels."""
    w, h = _c(width), _c(height)
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    return F.struct(F.floor(w * scale).cast("int").alias("width"), F.floor(h * scale).cast("int").alias("height"))


def pixels(points: ColumnOrName, dpi: int) -> Column:
    """Points of a 72nd of an inch as pixels."""
    return _c(points) * F.lit(dpi / 72.0)
