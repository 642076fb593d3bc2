"""Page regions: overlap, containment, suppression, routing and markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import trimmed

#: Class names by route; all others are text.
ROUTES = {
    "table": ["table"],
    "formula": ["display_formula", "isolate_formula"],
    "inline_formula": ["inline_formula"],
    "figure": ["image", "chart", "seal", "figure"],
    "skip": ["header", "footer", "header_image", "footer_image", "number", "formula_number", "abandon"],
}
#: Which class wins where boxes overlap; unknown classes come last.
PRIORITY = {
    1: ["doc_title", "paragraph_title", "figure_title", "title", "caption", "section_header"],
    2: ["image", "chart", "table", "seal", "figure", "equation"],
    3: ["display_formula", "inline_formula"],
    4: ["text", "abstract", "content", "reference", "reference_content", "footnote", "vision_footnote", "aside_text", "vertical_text", "algorithm", "plain text", "paragraph"],
}


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def _box(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}.{c}") for c in ("x1", "y1", "x2", "y2")]


def intersection(a: str, b: str) -> Column:
    """Common area of the boxes of two aliases."""
    ax1, ay1, ax2, ay2 = _box(a)
    bx1, by1, bx2, by2 = _box(b)
    return F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), F.lit(0.0)) * F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 where there is no area."""
    inter = intersection(a, b)
    return F.coalesce(F.try_divide(inter, area(*_box(a)) + area(*_box(b)) - inter), F.lit(0.0))


def contained(parent: str, child: str) -> Column:
    """The share of the child's area inside the parent; 0 for an empty child."""
    return F.when(area(*_box(child)) > 0, F.try_divide(intersection(parent, child), area(*_box(child)))).otherwise(F.lit(0.0))


def overlapping(boxes: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of boxes of one page (ids a < b) whose IoU is above the bound."""
    a, b = boxes.alias("a"), boxes.alias("b")
    pairs = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.unique_id") < F.col("b.unique_id")))
    return pairs.select("a.doc", "a.page", F.col("a.unique_id").alias("a_id"), F.col("b.unique_id").alias("b_id"), iou("a", "b").alias("iou")).where(F.col("iou") > least)


def without_covered_references(boxes: DataFrame, least: float = 0.80) -> DataFrame:
    """Boxes but reference blocks that hold at least two of their entries."""
    entries = boxes.where("class_name = 'reference_content'").alias("c")
    pairs = boxes.where("class_name = 'reference'").alias("p").join(entries, (F.col("p.doc") == F.col("c.doc")) & (F.col("p.page") == F.col("c.page"))).where(contained("p", "c") > least)
    covered = pairs.groupBy("p.doc", "p.page", "p.unique_id").count().where("count >= 2")
    return boxes.join(covered.select("doc", "page", "unique_id"), ["doc", "page", "unique_id"], "left_anti")


def priority(class_name: Column) -> Column:
    """1 to 4 for the known classes, 5 for others."""
    out = F.lit(5)
    for rank, names in PRIORITY.items():
        out = F.when(class_name.isin(names), rank).otherwise(out)
    return out


def _overlap(a: Column, b: Column) -> Column:
    """IoU of two box structs."""
    wide = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    high = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    size = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    return F.coalesce(F.try_divide(wide * high, size(a) + size(b) - wide * high), F.lit(0.0))


def suppressed(boxes: DataFrame) -> DataFrame:
    """Class-aware suppression, page by page: a box goes if a surer kept one nearly equals it or, of another class, outranks it.

    The boxes of a page, which are few, are folded in the order of confidence, then id.
    """
    fields = [c for c in boxes.columns if c not in ("doc", "page")]
    box = F.struct((-F.col("confidence")).alias("_c"), F.col("unique_id").alias("_u"), priority(F.col("class_name")).alias("_p"), *fields)
    pages = boxes.groupBy("doc", "page").agg(F.sort_array(F.collect_list(box)).alias("b"))

    def step(kept: Column, c: Column) -> Column:
        beats = lambda k: (_overlap(k, c) >= 0.95) | ((_overlap(k, c) >= 0.7) & (k["class_name"] != c["class_name"]) & (c["_p"] >= k["_p"]))
        return F.when(F.exists(kept, beats), kept).otherwise(F.concat(kept, F.array(c)))

    kept = F.aggregate("b", F.slice("b", 1, 0), step)
    return pages.select("doc", "page", F.explode(kept).alias("k")).select(*[c if c in ("doc", "page") else F.col(f"k.{c}") for c in boxes.columns])


def route(class_name: Column) -> Column:
    """text, table, formula, inline_formula, figure or skip."""
    out = F.lit("text")
    for name, classes in ROUTES.items():
        out = F.when(class_name.isin(classes), name).otherwise(out)
    return out


def text_only_pages(boxes: DataFrame) -> DataFrame:
    """(doc, page, full_page): whether a page has neither table nor formula, so that it is read whole."""
    return boxes.groupBy("doc", "page").agg((~F.bool_or(route(F.col("class_name")).isin("table", "formula"))).alias("full_page"))


def region_markdown(class_name: Column, text: Column) -> Column:
    """A region's markdown; null where it has none."""
    t = trimmed(F.coalesce(text, F.lit("")))
    c = class_name
    some = (
        F.when(c == "doc_title", F.concat(F.lit("# "), t))
        .when(c.isin("paragraph_title", "title"), F.concat(F.lit("## "), t))
        .when(c.isin("figure_title", "figure_caption", "table_caption"), F.concat(F.lit("*"), t, F.lit("*")))
        .when(c.isin("display_formula", "isolate_formula"), F.when(t.startswith("$$"), t).otherwise(F.concat(F.lit("$$\n"), t, F.lit("\n$$"))))
        .when(c == "inline_formula", F.when(t.startswith("$"), t).otherwise(F.concat(F.lit("$"), t, F.lit("$"))))
        .when(c == "algorithm", F.concat(F.lit("```\n"), t, F.lit("\n```")))
        .otherwise(t)
    )
    skip = ["header", "footer", "header_image", "footer_image", "number", "formula_number"]
    return F.when(c.isin("image", "chart", "seal", "figure"), "![Figure]").when(c.isin(skip) | (t == ""), F.lit(None)).otherwise(some)


def page_markdown(regions: DataFrame) -> DataFrame:
    """(doc, page, markdown) of regions with read_order, class_name and text."""
    rows = regions.withColumn("md", region_markdown(F.col("class_name"), F.col("text"))).where("md IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("read_order", "unique_id", "md")))
    return rows.groupBy("doc", "page").agg(F.array_join(F.transform(parts, lambda x: x["md"]), "\n\n").alias("markdown"))


def numbered(boxes: DataFrame) -> DataFrame:
    """Boxes with unique_id as their place in the page by read_order from 0; a box without an order comes last."""
    by = Window.partitionBy("doc", "page").orderBy(F.col("read_order").asc_nulls_last(), "unique_id")
    return boxes.withColumn("unique_id", F.row_number().over(by) - 1)


def prepared_regions(boxes: DataFrame, width: float, height: float, least: float = 0.25) -> DataFrame:
    """What of a page's boxes is read, with route and full_page: sure, in order, without suppressed and covered ones.

    A page without table and formula is read whole: full_page is true for all its rows.
    """
    kept = without_covered_references(suppressed(numbered(sure_boxes(boxes, width, height, least))))
    return kept.withColumn("route", route(F.col("class_name"))).join(text_only_pages(kept), ["doc", "page"])


def read_pages(regions: DataFrame, texts: DataFrame, whole: DataFrame) -> DataFrame:
    """(doc, page, markdown) of prepared regions, by the texts (doc, page, unique_id, text) that were read of them.

    A page that is read whole has the text of `whole` (doc, page, text) instead.
    """
    parts = regions.where("NOT full_page").join(texts.select("doc", "page", "unique_id", "text"), ["doc", "page", "unique_id"], "left")
    full = regions.where("full_page").select("doc", "page").distinct().join(whole.select("doc", "page", "text"), ["doc", "page"])
    return page_markdown(parts).unionByName(full.select("doc", "page", trimmed(F.col("text")).alias("markdown")))


def sure_boxes(boxes: DataFrame, width: float, height: float, least: float = 0.25) -> DataFrame:
    """Boxes of enough confidence, clamped to the image."""
    inside = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(top))).alias(c)
    keep = [c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")]
    return boxes.where(F.col("confidence") >= least).select(*keep, inside("x1", width), inside("y1", height), inside("x2", width), inside("y2", height))
