"""Ground truth of page extraction, from annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DET = "struct<category_type:string,text:string,html:string,latex:string,order:double>"
PAGES = f"page_info struct<image_path:string,page_no:int,page_attribute:struct<language:string,data_source:string>>, layout_dets array<{_DET}>"

#: Categories whose text belongs to the reading text.
TEXT = ["text_block", "title", "reference", "figure_caption", "table_caption", "table_footnote", "formula_caption", "equation_caption", "code_txt", "code_txt_caption"]


def _parts(categories: list[str], field: str) -> Column:
    """The field of annotations of some categories in reading order; those without a place come last."""
    some = F.filter("layout_dets", lambda d: d["category_type"].isin(categories) & (F.coalesce(d[field], F.lit("")) != ""))
    placed = F.transform(some, lambda d, i: F.struct(F.coalesce(d["order"], F.lit(float("inf"))).alias("o"), i.alias("i"), d[field].alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def page_truth(spark: SparkSession, path: str, language: str | None = None, source: str | None = None, tables: bool = False, formulas: bool = False) -> DataFrame:
    """id, page, text_blocks, text, table_html and formulas of each annotated page that the filters keep."""
    rows = spark.read.schema(PAGES).option("multiLine", True).json(path)
    if language is not None:
        rows = rows.where(F.col("page_info.page_attribute.language") == language)
    if source is not None:
        rows = rows.where(F.col("page_info.page_attribute.data_source") == source)
    out = rows.select(
        F.col("page_info.image_path").alias("id"), F.col("page_info.page_no").alias("page"), _parts(TEXT, "text").alias("text_blocks"), F.array_join(_parts(["table"], "html"), "\n").alias("table_html"),
        _parts(["equation_isolated"], "latex").alias("formulas"),
    ).withColumn("text", F.array_join("text_blocks", "\n"))
    if tables:
        out = out.where("table_html <> ''")
    return out.where("size(formulas) > 0") if formulas else out


CELLS = "array<struct<row_nums:array<int>,column_nums:array<int>,json_text_content:string,is_column_header:boolean>>"


def grid_html(cells: Column) -> Column:
    """A table's markup from cells that name their rows and columns; null without cells.

    Places are looked at row by row.  One that a cell of before spans has nothing, one where
    a cell begins has it, with spans as its rows and columns are counted, and any other is an
    empty cell.  Of several cells that begin at a place the first counts, and cells without
    rows or columns only widen the grid.
    """
    last = lambda field: F.coalesce(F.array_max(F.flatten(F.transform(cells, lambda c: F.coalesce(c[field], F.array().cast("array<int>"))))), F.lit(0))
    sound = F.filter(cells, lambda c: (F.size(c["row_nums"]) > 0) & (F.size(c["column_nums"]) > 0))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    tag = lambda c: F.when(F.coalesce(c["is_column_header"], F.lit(False)), "th").otherwise("td")
    spanned = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def begun(c: Column, i: Column) -> Column:
        high, wide = F.size(c["row_nums"]), F.size(c["column_nums"])
        markup = F.concat(F.lit("<"), tag(c), spanned("rowspan", high), spanned("colspan", wide), F.lit(">"), escaped(F.coalesce(c["json_text_content"], F.lit(""))), F.lit("</"), tag(c), F.lit(">"))
        return F.struct(F.array_min(c["row_nums"]).alias("r"), F.array_min(c["column_nums"]).alias("c"), i.alias("i"), high.alias("high"), wide.alias("wide"), markup.alias("markup"))

    # only cells of several places cover others, and each of them unless one before covers its begin or has it too
    over = lambda s, r, c: r.between(s["r"], s["r"] + s["high"] - 1) & c.between(s["c"], s["c"] + s["wide"] - 1)

    def covering(placed: Column) -> Column:
        large = F.filter(placed, lambda x, k: ((x["high"] > 1) | (x["wide"] > 1)) & ((k == 0) | (F.get(placed, k - 1)["r"] != x["r"]) | (F.get(placed, k - 1)["c"] != x["c"])))
        return F.aggregate(large, F.filter(placed, lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda s: over(s, x["r"], x["c"])), acc).otherwise(F.concat(acc, F.array(x))))

    def row(own: Column, spans: Column, r: Column, wide: Column) -> Column:
        begins = lambda c: F.coalesce(F.get(F.filter(own, lambda x: x["c"] == c), F.lit(0))["markup"], F.lit("<td></td>"))
        taken = lambda c: F.exists(spans, lambda s: over(s, r, c) & ((s["r"] != r) | (s["c"] != c)))
        pieces = F.transform(F.sequence(F.lit(0), wide - 1), lambda c: F.when(taken(c), "").otherwise(begins(c)))
        return F.concat(F.lit("<tr>"), F.array_join(pieces, ""), F.lit("</tr>"))

    # what several places read is bound before: a lambda would work it out anew at each of them
    def markup(placed: Column, spans: Column, high: Column, wide: Column) -> Column:
        of_row = lambda r: F.struct(F.filter(placed, lambda x: x["r"] == r).alias("own"), F.filter(spans, lambda s: r.between(s["r"], s["r"] + s["high"] - 1)).alias("spans"))
        rows = F.transform(F.sequence(F.lit(0), high - 1), lambda r: once(of_row(r), lambda g: row(g["own"], g["spans"], r, wide)))
        return F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))

    size = F.struct((last("row_nums") + 1).alias("high"), (last("column_nums") + 1).alias("wide"))
    table = lambda placed: once(size, lambda n: once(covering(placed), lambda spans: markup(placed, spans, n["high"], n["wide"])))
    return F.when(F.size(cells) > 0, once(F.array_sort(F.transform(sound, begun)), table))


def grid_tables(spark: SparkSession, structures: str, annotations: str, images: DataFrame) -> DataFrame:
    """id, image_path and table_html of the tables that have a structure file and an image (key).

    A structure is an XML file PAGE_table_N.xml; its cells are those of the N-th table of the
    page's annotations, PAGE_tables.json, and its image is PAGE_table_N.jpg.  A table without
    annotations has a null table_html.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(structures)
    name = lambda path, end: F.regexp_extract(path, rf"([^/]*)\.{end}$", 1)
    stem = name(F.col("path"), "xml")
    page, number = F.regexp_extract("id", r"^(.*)_table_(.*)$", 1), F.regexp_extract("id", r"^(.*)_table_(.*)$", 2)
    tables = files.select(stem.alias("id")).select("id", F.when(page != "", page).otherwise(F.col("id")).alias("page"), F.coalesce(number.try_cast("int"), F.lit(0)).alias("n"))
    pictures = images.where(F.endswith("key", F.lit(".jpg"))).select(name(F.col("key"), "jpg").alias("id"), F.col("key").alias("image_path"))
    text = spark.read.text(annotations, wholetext=True, pathGlobFilter="*_tables.json")
    parsed = F.from_json("value", f"array<struct<cells:{CELLS}>>")
    of_page = text.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_tables\.json$", 1).alias("page"), parsed.alias("tables"))
    rows = tables.join(pictures, "id").join(of_page, "page", "left")
    return rows.select("id", "image_path", grid_html(F.get("tables", F.col("n"))["cells"]).alias("table_html"))


def document_pairs(spark: SparkSession, root: str, splits: tuple[str, ...] = ("arxiv", "github")) -> DataFrame:
    """id (split:stem), pdf_path and markdown of the PDF files of each split, SPLIT/pdf/STEM.pdf, with the truth of SPLIT_ground_truth/STEM.md where there is one."""
    out = None
    for split in splits:
        pdfs = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(f"{root}/{split}/pdf").select(F.col("path").alias("pdf_path"))
        truth = spark.read.text(f"{root}/{split}_ground_truth", wholetext=True, pathGlobFilter="*.md").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("stem"), F.col("value").alias("markdown"))
        rows = pdfs.withColumn("stem", F.regexp_extract("pdf_path", r"([^/]*)\.pdf$", 1)).join(truth, "stem", "left")
        rows = rows.select(F.concat(F.lit(split + ":"), "stem").alias("id"), "pdf_path", "markdown")
        out = rows if out is None else out.unionByName(rows)
    return out
