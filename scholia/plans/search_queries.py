"""Registered queries of provider searches: documents as recorded answers, read back through the data source."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions.dates import DateFilter
from scholia.plans.queries import query
from scholia.plans.views import table
from scholia.plans.written import folder
from scholia.sources.paper_search import BY_DAY, ONE_PAGE, record, search
from scholia.sources.search_urls import Search, search_url

SEARCHES: dict[str, str] = {}
DATES, PAGE, TEXT = ">=2016-03 <2019", 100, "graph"


def _items(name: str) -> tuple[Column, str, str]:
    """A document as the provider's item, and what stands around the items of a response."""
    i, day = F.col("doc_id").cast("string"), F.col("day")
    year, title = F.year("day"), F.concat(F.lit("Title "), F.col("doc_id").cast("string"))
    if name == "arxiv":
        entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), i, F.lit("v1</id><title>"), title, F.lit("</title><published>"), day.cast("string"), F.lit("T10:00:00Z</published></entry>"))
        return entry, "<feed>", "</feed>"
    made = {
        "openalex": (["id", "display_name", "publication_date"], [F.concat(F.lit("https://openalex.org/"), i), title, day.cast("string")], '{"results": [', "]}"),
        "semantic_scholar": (["paperId", "title", "year"], [i, title, year], '{"data": [', "]}"),
        "crossref": (["DOI", "title", "published"], [i, F.array(title), F.struct(F.array(F.array(year, F.month("day"), F.dayofmonth("day"))).alias("date-parts"))], '{"message": {"items": [', "]}}"),
        "europe_pmc": (["id", "title", "firstPublicationDate"], [i, title, day.cast("string")], '{"resultList": {"result": [', "]}}"),
        "core": (["id", "title", "yearPublished"], [F.col("doc_id"), title, year], '{"results": [', "]}"),
    }
    names, columns, begin, end = made[name]
    return F.to_json(F.struct(*[c.alias(n) for n, c in zip(names, columns)])), begin, end


def _searched(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    dates = DateFilter.parse(DATES)
    item, begin, end = _items(name)
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").withColumn("day", F.date_add(F.lit(date(2015, 1, 1)), (F.col("doc_id") % 3000).cast("int")))
    answer = docs.where(dates.condition("day")) if name in BY_DAY else docs.where(F.year("day").between(dates.after.year, dates.before.year))
    # answers are dealt to pages by range of the id, and numbered by the pages' sizes
    placed = answer.select("doc_id", item.alias("item")).withColumn("bucket", F.floor(F.col("doc_id") / PAGE))
    sizes = placed.groupBy("bucket").count().sort("bucket").collect()  # a row a page of answers
    before, starts = 0, []
    for r in sizes:
        starts.append((r["bucket"], before))
        before += r["count"]
    starts = spark.createDataFrame(starts, "bucket long, start long")
    rank = F.col("start") + F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")) - 1
    ranked = placed.join(starts, "bucket").withColumn("rank", rank).withColumn("page", F.floor(F.col("rank") / PAGE))
    separator = "" if name == "arxiv" else ", "
    bodies = ranked.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), separator).alias("items"))
    of = lambda k: search_url(name, "https://api", Search(TEXT, dates=dates, limit=PAGE, offset=k * PAGE))
    pages = range(1 if name in ONE_PAGE else -(-before // PAGE))
    urls = spark.createDataFrame([(k, of(k)) for k in pages], "page long, url string")
    recorded = f"{folder(spark)}/answers/{uuid.uuid4().hex}"
    record(bodies.join(urls, "page").select("url", F.concat(F.lit(begin), "items", F.lit(end)).alias("payload")), recorded)
    found = search(spark, name, TEXT, recorded, max(before, 1), DATES, base="https://api", page_size=str(PAGE))
    return found.select("id", "title", F.col("publication_date").cast("string").alias("publication_date"))


def _register(name: str) -> None:
    def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _searched(spark, sf_dir, name)

    searched.__name__ = f"search_{name}"
    query(searched)
    day = "DATE '2015-01-01' + CAST(doc_id % 3000 AS INTEGER)"
    day = day if name in BY_DAY else f"make_date(year({day}), 1, 1)"
    SEARCHES[searched.__name__] = (
        f"SELECT CAST(doc_id AS VARCHAR) AS id, 'Title ' || doc_id AS title, CAST(CAST(d AS DATE) AS VARCHAR) AS publication_date FROM (SELECT doc_id, {day} AS d FROM documents) WHERE d >= DATE '2016-03-01' AND d < DATE '2019-01-01'"
        + (f" ORDER BY doc_id LIMIT {PAGE}" if name in ONE_PAGE else "")
    )


for _name in ("arxiv", "openalex", "semantic_scholar", "crossref", "europe_pmc", "core"):
    _register(_name)


@query
def grid_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as annotated tables: a line is a row of one wide cell, of two, or of one beside an empty place."""
    from scholia.sources.benchmarks import CELLS, grid_html

    # lines are dealt by order once, for both groupings
    dealt = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").repartition("l_orderkey")
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_returnflag").alias("flag"))
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p", "flag"))).alias("lines"))
    cell = lambda r, columns, text, head: F.struct(F.array(r).alias("row_nums"), columns.alias("column_nums"), text.alias("json_text_content"), head.alias("is_column_header"))
    p = lambda x: x["p"]
    first = lambda x, r: cell(r, F.when(p(x) % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))), F.concat(p(x).cast("string"), F.lit(" <&>")), r == 0)
    second = lambda x, r: F.when((p(x) % 3 != 0) & (p(x) % 5 != 0), cell(r, F.array(F.lit(1)), x["flag"], F.lit(False)))
    cells = F.flatten(F.transform("lines", lambda x, r: F.array_compact(F.array(first(x, r), second(x, r))))).cast(CELLS)
    return orders.select("l_orderkey", cells.alias("cells")).select("l_orderkey", F.explode(F.array(grid_html(F.col("cells")))).alias("html"))


SEARCHES["grid_markup"] = """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS r, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1 THEN 'th' ELSE 'td' END AS tag,
  bool_or(p % 3 = 0 OR p % 5 <> 0) OVER (PARTITION BY l_orderkey) AS wide FROM l)
SELECT l_orderkey, '<table>' || string_agg('<tr><' || tag || CASE WHEN p % 3 = 0 THEN ' colspan="2"' ELSE '' END || '>' || p || ' &lt;&amp;&gt;</' || tag || '>'
  || CASE WHEN p % 3 = 0 OR NOT wide THEN '' WHEN p % 5 <> 0 THEN '<td>' || flag || '</td>' ELSE '<td></td>' END || '</tr>', '' ORDER BY r) || '</table>' AS html FROM r GROUP BY l_orderkey"""
