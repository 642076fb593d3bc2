"""Tables of a page as rows of cells, and the tree edit distance of two of them in array expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CELL = T.StructType([T.StructField("text", T.StringType()), T.StructField("colspan", T.IntegerType()), T.StructField("rowspan", T.IntegerType())])
TABLES = T.ArrayType(T.ArrayType(T.ArrayType(_CELL)))

#: Tags that go from a table while their content stays, and attributes that go.
DROPPED_TAGS = ["sub", "sup", "span", "div", "p", "li", "ul", "ol", "i", "b", "em", "strong", "html", "body", "tbody"]
DROPPED_ATTRIBUTES = ["style", "height", "width", "align", "class", "border"]


def canonical_table(html: Column) -> Column:
    """Table markup without column groups, formatting tags and layout attributes, and with data cells for header cells."""
    s = F.regexp_replace(html, r"(?is)<colgroup.*?</colgroup>", "")
    tags = "|".join(DROPPED_TAGS)
    s = F.regexp_replace(s, rf"(?i)<(?:{tags})(?: [^>]*)?>|</(?:{tags})>", "")
    s = F.regexp_replace(s, rf'(?i) ?(?:{"|".join(DROPPED_ATTRIBUTES)})="[^"]*"', "")
    return F.regexp_replace(F.regexp_replace(s, r"</(?:th|TH)>", "</td>"), r"<(?:th|TH)([ >])", "<td$1")

class _Tables(HTMLParser):
    """Tables as lists of rows of (text, colspan, rowspan)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.cell = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif self.tables and tag == "tr":
            self.tables[-1].append([])
            self.cell = False
        elif self.tables and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            span = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and v and v.isdigit()}
            self.tables[-1][-1].append(["", span.get("colspan", 1), span.get("rowspan", 1)])
            self.cell = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = False

    def handle_data(self, data):
        if self.cell:
            self.tables[-1][-1][-1][0] += data


def parse_tables(html: str) -> list[list[list[tuple]]]:
    reader = _Tables()
    reader.feed(html)
    return [[[tuple(c) for c in row] for row in t] for t in reader.tables]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and let `use` build an expression of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _below(n: Column) -> Column:
    """0 to n - 1."""
    return F.slice(F.sequence(F.lit(0), n), 1, n)


def _walk(previous: Column, first: Column, steps: Column, change: Callable[[Column, Column], Column]) -> Column:
    """The next row of an edit distance: what comes in, goes and changes, step by step; change(previous, k) is the price of step k's change with what it leads on from."""
    start = F.array(first)
    return F.aggregate(steps, start, lambda acc, k: F.concat(acc, F.array(F.least(F.get(previous, k + 1) + 1, F.element_at(acc, -1) + 1, change(previous, k)))))


def _cell_change(x: Column, y: Column) -> Column:
    """The price of changing a cell to another: one for other spans, else the texts' distance."""
    other = (x["colspan"] != y["colspan"]) | (x["rowspan"] != y["rowspan"])
    return F.when(other, F.lit(1.0)).otherwise(F.levenshtein(x["text"], y["text"]) / F.greatest(F.octet_length(x["text"]), F.octet_length(y["text"]), F.lit(1)))


def _cell_changes(a: Column, b: Column) -> Column:
    """The price of changing each cell of one table to each of the other."""
    return F.transform(F.flatten(a), lambda x: F.transform(F.flatten(b), lambda y: _cell_change(x, y)))


def cell_by_cell(a: Column, b: Column) -> Column:
    """The edit distance of two tables whose rows have the same numbers of cells, where it is that of changing each cell to the one at its place; else null.

    What else one may do takes a node away and brings one in, at two.  So nothing is cheaper
    than changes of two in all.  Where all rows have two cells a node that goes and one that
    comes leave the same rows only if they are of one row, whose two changes cost no more
    than they; two of each cost four.
    """
    sizes = lambda t: F.transform(t, lambda row: F.size(row))
    total = F.aggregate(F.zip_with(F.flatten(a), F.flatten(b), _cell_change), F.lit(0.0), lambda acc, x: acc + x)
    most = F.when(F.forall(a, lambda row: F.size(row) == 2), 4.0).otherwise(2.0)
    return F.when(sizes(a) == sizes(b), _let(total, lambda t: F.when(t <= most, t)))


def _rows(table: Column) -> Column:
    """array<struct(at, n)>: the number of each row's first cell, and of its cells."""
    sizes = F.transform(table, lambda r: F.size(r))
    return F.transform(sizes, lambda n, k: F.struct(F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda acc, x: acc + x).alias("at"), n.alias("n")))


def _nodes(rows: Column) -> Column:
    """array<struct(row, cell, begin)>: cells and rows as they end, a row behind its cells with cell null; begin is where its first node stands."""

    def of(r: Column, k: Column) -> Column:
        cells = F.transform(_below(r["n"]), lambda i: F.struct(k.alias("row"), (r["at"] + i).alias("cell"), (r["at"] + i + k).alias("begin")))
        return F.concat(cells, F.array(F.struct(k.alias("row"), F.lit(None).cast("int").alias("cell"), (r["at"] + k).alias("begin"))))

    return F.flatten(F.transform(rows, of))


def _row_change(changes: Column, x: Column, y: Column) -> Column:
    """The edit distance of the cells of two rows."""
    start = F.transform(F.sequence(F.lit(0), y["n"]), lambda k: k.cast("double"))
    step = lambda acc, i: _walk(acc, F.get(acc, F.lit(0)) + 1, _below(y["n"]), lambda p, k: F.get(p, k) + F.get(F.get(changes, x["at"] + i), y["at"] + k))
    return F.element_at(F.aggregate(_below(x["n"]), start, step), -1)


def tree_distance(a: Column, b: Column) -> Column:
    """The edit distance of two tables as trees of cells below rows below the table; a node that goes leaves its children to its parent.

    Trees of this depth need one dynamic program over their nodes as they end: the nodes
    before, or, where a row is matched, the nodes before its first cell.  A cell may also be
    matched with a row, or with one cell of it.
    """

    def program(changes: Column, ra: Column, rb: Column, rows: Column, na: Column, nb: Column) -> Column:
        steps = _below(F.size(nb))
        begin = F.transform(F.sequence(F.lit(0), F.size(nb)), lambda k: k.cast("double"))
        alone = lambda n, some: n + F.least(F.lit(1.0), F.coalesce(F.array_min(some), F.lit(1.0)))

        def step(acc: Column, x: Column) -> Column:
            row = F.get(ra, x["row"])
            # what was there before the row began
            start = F.when((x["cell"] == row["at"]) | (row["n"] == 0), acc["now"]).otherwise(acc["start"])

            def change(previous: Column, k: Column) -> Column:
                y = F.get(nb, k)
                other = F.get(rb, y["row"])
                both_cells = F.get(previous, k) + F.get(F.get(changes, x["cell"]), y["cell"])
                to_row = F.get(previous, y["begin"]) + F.when(other["n"] == 0, 1.0).otherwise(alone(other["n"], F.slice(F.get(changes, x["cell"]), other["at"] + 1, other["n"])))
                from_row = F.get(start, k) + F.when(row["n"] == 0, 1.0).otherwise(alone(row["n"], F.transform(F.slice(changes, row["at"] + 1, row["n"]), lambda c: F.get(c, y["cell"]))))
                both_rows = F.get(start, y["begin"]) + F.get(F.get(rows, x["row"]), y["row"])
                return F.when(x["cell"].isNotNull(), F.when(y["cell"].isNotNull(), both_cells).otherwise(to_row)).otherwise(F.when(y["cell"].isNotNull(), from_row).otherwise(both_rows))

            return F.struct(_walk(acc["now"], F.get(acc["now"], F.lit(0)) + 1, steps, change).alias("now"), start.alias("start"))

        return F.element_at(F.aggregate(na, F.struct(begin.alias("now"), begin.alias("start")), step)["now"], -1)

    def with_rows(changes: Column, ra: Column, rb: Column) -> Column:
        matrix = F.transform(ra, lambda x: F.transform(rb, lambda y: _row_change(changes, x, y)))
        return _let(matrix, lambda rows: _let(_nodes(ra), lambda na: _let(_nodes(rb), lambda nb: program(changes, ra, rb, rows, na, nb))))

    return _let(_cell_changes(a, b), lambda changes: _let(_rows(a), lambda ra: _let(_rows(b), lambda rb: with_rows(changes, ra, rb))))


def pair_score(a: Column, b: Column) -> Column:
    """100 (1 - distance / nodes of the larger tree) of two tables; null where one is missing."""
    nodes = lambda t: F.size(t) + F.size(F.flatten(t)) + 1
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), 1 - F.coalesce(cell_by_cell(a, b), tree_distance(a, b)) / F.greatest(nodes(a), nodes(b))) * 100)


def page_tables(html: Column) -> Column:
    """The tables of a page; none for a null.  One plain table is read by expressions, other pages by the parser."""
    plain = F.coalesce(html.rlike(r"\A<table>(?:<tr>(?:<td>[^<&]*</td>)*</tr>)*</table>\z"), F.lit(False))
    inner = lambda x, tag: F.regexp_extract_all(x, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    cell = lambda x: F.struct(x.alias("text"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))
    read = F.array(F.transform(inner(html, "tr"), lambda row: F.transform(inner(row, "td"), cell)))
    return F.when(plain, read).otherwise(tables_of(F.when(~plain, html)))


@F.pandas_udf(TABLES)
def tables_of(html: pd.Series) -> pd.Series:
    """The tables of each page; none for a null."""
    names = ("text", "colspan", "rowspan")
    return pd.Series([[[[dict(zip(names, cell)) for cell in row] for row in table] for table in parse_tables(x or "")] for x in html], dtype=object)
