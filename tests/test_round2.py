import io
import json
import zipfile
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.functions.dates import DateFilter
from scholia.operators import catalog as C
from scholia.operators import evaluate as E
from scholia.operators import layout as L
from scholia.operators import vectors as V
from scholia.plans.indexing import index_documents, semantic_search, with_metadata
from scholia.plans.metasearch import all_sources, by_doi, ranked_by_place
from scholia.schemas import CATALOG, PAPERS, REGIONS
from scholia.sources.epub import epub_html
from scholia.sources.inbox import processable, without_unfinished
from scholia.sources.outputs import json_lines, tab_lines
from scholia.sources.search_urls import Search, search_url

DATES = DateFilter.parse(">=2020-02 <2021-03-01")


@pytest.mark.parametrize(
    "provider,search,path,want",
    [
        ("arxiv", Search("two words", dates=DATES, offset=3), "", {"search_query": 'all:"two words" AND submittedDate:[20200201000000 TO 20210228235959]', "start": "3", "max_results": "10", "sortBy": "relevance", "sortOrder": "descending"}),
        ("arxiv", Search("a AND b", "title", order="date"), "", {"search_query": "ti:a AND ti:AND AND ti:b", "sortBy": "submittedDate"}),
        ("arxiv", Search("x", dates=DateFilter.parse(">=2020")), "", {"search_query": "all:x AND submittedDate:[20200101000000 TO 999912312359]"}),
        ("openalex", Search("q", dates=DATES, limit=500, offset=1000), "/works", {"search": "q", "filter": "from_publication_date:2020-02-01,to_publication_date:2021-02-28", "sort": "relevance_score:desc", "per_page": "200", "page": "3"}),
        ("openalex", Search("q", "author"), "/works", {"filter": "authorships.author.display_name.search:q", "sort": None}),
        ("semantic_scholar", Search("q", dates=DateFilter.parse("<2021"), order="citations", limit=101), "/graph/v1/paper/search", {"query": "q", "year": "-2021", "sort": "citationCount:desc", "limit": "100"}),
        ("crossref", Search("q", "title", dates=DATES, order="date"), "/works", {"query.bibliographic": "q", "filter": "from-pub-date:2020-02-01,until-pub-date:2021-02-28", "sort": "published", "order": "desc"}),
        ("europe_pmc", Search("two words", dates=DateFilter.parse("<2021"), order="citations"), "/webservices/rest/search", {"query": '"two words" FIRST_PDATE:[1900-01-01 TO 2020-12-31]', "sort": "CITED desc", "cursorMark": "*"}),
        ("core", Search("q", "author", dates=DATES), "/v3/search/works", {"q": '(authors:"q") AND yearPublished>=2020 AND yearPublished<=2021'}),
    ],
)
def test_search_urls(provider, search, path, want):
    url = urlsplit(search_url(provider, "http://h", search))
    got = parse_qs(url.query)
    assert url.path == path
    assert {k: got.get(k, [None])[-1] for k in want} == want


def test_more_parameters():
    assert parse_qs(urlsplit(search_url("crossref", "http://h", Search("q"), mailto="a@b")).query)["mailto"] == ["a@b"]


def test_metadata_and_semantic_search(spark):
    body = " ".join(f"word{i} of a long enough text about whales" for i in range(20))
    docs = spark.createDataFrame([("s1", body), ("s2", "Written in 1999.\n" + body.replace("whales", "stars")), ("s3", "short"), (None, body)], "doc_id string, text string")
    cat = spark.createDataFrame([("s1", "Whales", ["A", "B"], "10.1/x", "2020-03-01", ["sea"])], "stem string, title string, authors array<string>, doi string, publication_date string, topics array<string>")
    meta = {r.doc_id: r for r in with_metadata(docs, cat, this_year=2024).collect()}
    assert (meta["s1"].title, meta["s1"].year, meta["s1"].pdf_path) == ("Whales", 2020, "papers/s1/s1.pdf")
    assert (meta["s2"].title, meta["s2"].year, meta["s2"].doi) == (None, 1999, None) and meta["s3"].year is None and len(meta) == 4
    points = index_documents(docs.where("doc_id IS NOT NULL"), catalog=cat)
    hits = semantic_search(points, "whales", limit=5).collect()
    assert [h.doc_id for h in hits] == ["s1", "s2"] and (hits[0].title, hits[0].authors, hits[0].page) == ("Whales", ["A", "B"], 1)
    assert [h.doc_id for h in semantic_search(points, "whales", year=">=2000").collect()] == ["s1"]
    assert [h.doc_id for h in semantic_search(points, "whales", topic="sea").collect()] == ["s1"]
    assert len(semantic_search(points, "whales", year="no year").collect()) == 2
    with pytest.raises(ValueError):
        semantic_search(points, "  ")
    # what points don't carry is null
    assert semantic_search(index_documents(docs.where("doc_id = 's1'")), "whales").first().title is None


def test_sources(spark):
    a = spark.createDataFrame([("1", "arxiv", 2), ("2", "arxiv", 1)], "id string, source string, place int")
    b = spark.createDataFrame([("3", "core", 5, "t")], "id string, source string, place int, title string")
    rows, report = all_sources({"arxiv": a, "crossref": TimeoutError("slow"), "core": b})
    got = {r.id: (r["rank"], r.title) for r in ranked_by_place(rows, "place").collect()}
    assert got == {"1": (1, None), "2": (0, None), "3": (0, "t")}
    assert {(r.source, r.ok, r.error) for r in report.collect()} == {("arxiv", True, None), ("crossref", False, "slow"), ("core", True, None)}
    with pytest.raises(RuntimeError):
        all_sources({"core": ValueError("x")})


def test_doi_lookup(spark):
    p = lambda i, doi, source, title: {"id": i, "doi": doi, "source": source, "title": title, "rank": 0}
    rows = [p("a", "10.1/X", "core", "short"), p("b", "https://doi.org/10.1/x", "openalex", "a longer title"), p("c", "10.48550/arXiv.1", "core", "no"), p("d", "10.48550/arXiv.1", "arxiv", "yes")]
    df = spark.createDataFrame(rows, PAPERS)
    assert [(r.id, r.title) for r in by_doi(df, "10.1/x").collect()] == [("b", "a longer title")]
    assert [r.title for r in by_doi(df, "10.48550/arxiv.1").collect()] == ["yes"] and by_doi(df, "10.9/q").count() == 0


def test_catalog_rows(spark):
    objects = spark.createDataFrame([("c/ab/abc.yaml",), ("c/._x.yaml",), ("c/q.md",)], "key string")
    assert [r.stem for r in C.stems(objects).collect()] == ["abc"]
    cat = spark.createDataFrame([{"stem": s} for s in "abc"], CATALOG)
    assert {r.stem for r in C.delete(cat, spark.createDataFrame([("a",), ("a",)], "stem string")).collect()} == {"b", "c"}
    plan = spark.createDataFrame([("x", f"s{i:02}", None) for i in range(15)] + [("y", "q", "d")], "direction string, stem string, detail string")
    got = C.repair_samples(plan).orderBy("direction", "n").collect()
    assert len(got) == 11 and [r.stem for r in got[:10]] == [f"s{i:02}" for i in range(10)]
    actions = C.reconcile_actions(spark.createDataFrame([("a", "stamp_missing"), ("b", "embed_missing"), ("c", "ok")], "stem string, class string"))
    assert {tuple(r) for r in actions.collect()} == {("a", "fix_stamp"), ("b", "reembed")}
    fixed = {r.stem: r.embedding for r in C.fixed_stamps(cat, actions, spark.createDataFrame([("a", 4), ("b", 5)], "doc_id string, n_chunks int"), F.lit("t")).collect()}
    assert fixed["a"].chunks_indexed == 4 and fixed["b"] is None and len(fixed) == 3


def test_points(spark, tmp_path):
    points = spark.createDataFrame([("a", 0, 2020), ("a", 1, 2020), ("b", 0, 2021), (None, 0, None)], "doc_id string, chunk_index int, year int")
    assert V.purge(points, ["a"]).count() == 2
    got = V.reindexed(points, points.where("doc_id = 'a' AND chunk_index = 0"), spark.createDataFrame([("a",), ("b",)], "doc_id string"))
    assert sorted((r.doc_id or "", r.chunk_index) for r in got.collect()) == [("", 0), ("a", 0)]
    V.partitioned_write(points, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 4 and "PartitionFilters: [isnotnull(year" in back.where("year = 2020")._jdf.queryExecution().toString()


def test_regions(spark):
    box = lambda i, order, name, x, conf=0.9: ("d", 1, x, 0.0, x + 10, 10.0, conf, name, order, i)
    rows = [box(5, 2.0, "text", 0.0), box(6, 1.0, "table", 20.0), box(7, 3.0, "text", 0.1, 0.5), box(8, 0.0, "text", 50.0, 0.1), box(9, None, "header", 70.0)]
    got = L.prepared_regions(spark.createDataFrame(rows, REGIONS), 75, 100).orderBy("unique_id").collect()
    # the unsure box goes before the numbering, the doubled one after it, and the last is clamped
    assert [(r.unique_id, r.class_name, r.route, r.full_page, r.x2) for r in got] == [(0, "table", "table", False, 30.0), (1, "text", "text", False, 10.0), (3, "header", "skip", False, 75.0)]
    regions = spark.createDataFrame(got)
    texts = spark.createDataFrame([("d", 1, 0, "cells"), ("d", 1, 1, "words")], "doc string, page int, unique_id int, text string")
    whole = spark.createDataFrame([("d", 1, " all ")], "doc string, page int, text string")
    assert [tuple(r) for r in L.read_pages(regions, texts, whole).collect()] == [("d", 1, "cells\n\nwords")]
    plain = regions.withColumn("full_page", F.lit(True))
    assert [tuple(r) for r in L.read_pages(plain, texts, whole).collect()] == [("d", 1, "all")]


def test_scored_pages(spark):
    t = "<table><tr><td>a</td></tr></table>"
    rows = [(1, "a b c d e", "$x$", t, "a b c d e", "$x$", t), (2, "a b c d", "", "", None, None, None), (3, "a b c d e", "", t, "a b c d e", None, None)]
    df = spark.createDataFrame(rows, "id int, text string, formula string, tables string, found_text string, found_formula string, found_tables string")
    got = {r.id: r for r in E.scored_pages(df).collect()}
    assert (got[1].ned, got[1].bleu, got[1].text, got[1].table, got[1].formula, got[1].composite) == (0, 1, 100, 100, 100, 100)
    assert (got[2].failed, got[2].ned, got[2].bleu, got[2].composite, got[2].table, got[2].formula) == (True, 1, 0, 0, None, None)
    assert (got[3].table, got[3].formula, got[3].composite) == (0, None, 50)
    sums = {r.dataset: r for r in E.report(E.scored_pages(df).withColumn("dataset", F.when(F.col("id") < 3, "p").otherwise("q"))).collect()}
    assert sums["all"].n_pages == 3 and sums["p"].mean_ned == 0.5 and sums["q"].mean_formula == 0


def test_small_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(T.age_text(F.lit(s))) for s in (5, 119, 7200, 200000)] == ["5s ago", "1m ago", "2h ago", "2d ago"]
    tokens = F.array(*map(F.lit, ["<tr>", "<td></td>", "<td", ' colspan="2"', ">", "</td>", "<td></td>", "</tr>"]))
    assert one(T.table_html(tokens, F.array(F.lit("a"), F.lit("b")))) == '<table><tr><td>a</td><td colspan="2">b</td><td></td></tr></table>'
    assert tuple(one(T.downscaled(F.lit(2000), F.lit(500), 1000))) == (1000, 250) and tuple(one(T.downscaled(F.lit(20), F.lit(50), 1000))) == (20, 50)
    assert one(T.pixels(F.lit(144.0), 150)) == 300
    keys = ["a/x.pdf", "a/._x.pdf", "a/x.tmp", "a/corrupted/x.pdf", "a/x.epub", "noext", "a/x.PDF"]
    assert [one(processable(F.lit(k))) for k in keys] == [True, False, False, False, True, False, False]
    listing = spark.createDataFrame([("a/x.pdf",), ("a/y.pdf",), ("a/y.pdf.tmp",)], "key string")
    assert [r.key for r in without_unfinished(listing).collect()] == ["a/x.pdf"]


def test_outputs(spark):
    rows = spark.createDataFrame([{"id": "1", "title": "T", "authors": [{"name": "A", "affiliations": []}, {"name": "B", "affiliations": []}], "doi": None}], PAPERS)
    assert tab_lines(rows).first().value == "T\tA, B\t\t-"
    assert json.loads(json_lines(rows.select("id", "doi")).first().value) == {"id": "1", "doi": None}


def test_epub(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>')
        z.writestr("O/b.opf", '<package xmlns="p"><manifest><item id="1" href="one%20a.xhtml"/><item id="2" href="two.xhtml"/></manifest><spine><itemref idref="2"/><itemref idref="1"/><itemref idref="9"/></spine></package>')
        z.writestr("O/one a.xhtml", "<?xml version='1.0'?>\n<p>one</p>")
        z.writestr("O/two.xhtml", "<p>two</p>")
    df = spark.createDataFrame([(bytearray(out.getvalue()),), (bytearray(b"no book"),), (None,)], "c binary")
    assert [r[0] for r in df.select(epub_html("c")).collect()] == ["<p>two</p>\n<p>one</p>", None, None]


def test_cascade(spark, tmp_path):
    from scholia.streaming import cascade as K

    root = f"file://{tmp_path}"
    body = "<html><body>" + "".join(f"<p>Paragraph {i} of a page with quite enough words to be no stub, number {i * 7}.</p>" for i in range(30)) + "</body></html>"
    pages = spark.createDataFrame([("papers/aa/aab.html", body, 3.0), ("papers/st/stub.html", "<p>x</p>", 3.0), ("papers/cc/ccd.html", body, 3.0)], "key string, html string, duration double")

    def send(name, *keys):
        (tmp_path / "topics/ingested").mkdir(parents=True, exist_ok=True)
        lines = [json.dumps({"subject": "ingested", "payload": json.dumps({"key": k}), "at": "2024-01-01T00:00:00.000Z"}) for k in keys]
        (tmp_path / "topics/ingested" / name).write_text("\n".join(lines))

    def run():
        for start in (lambda: K.convert_stream(spark, root, lambda e: e.join(pages, "key")), lambda: K.index_stream(spark, root)):
            query = start()
            query.awaitTermination()
            assert query.exception() is None

    listener = K.Progress()
    spark.streams.addListener(listener)
    send("1.json", "papers/aa/aab.html", "papers/st/stub.html", "papers/aa/aab.html")
    run()
    send("2.json", "papers/cc/ccd.html", "papers/aa/aab.html")
    run()
    spark.streams.removeListener(listener)
    md = {(r.stem, r.outcome) for r in K.markdown(spark, root).collect()}
    assert md == {("aab", "ok"), ("stub", "stub"), ("ccd", "ok")}
    said = spark.read.json(f"{tmp_path}/topics/indexed/*")
    assert {json.loads(r.payload)["key"] for r in said.collect()} == {"markdown/aa/aab.md", "markdown/cc/ccd.md"}
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/points").select("doc_id").distinct().collect()} == {"aab", "ccd"}
    assert all("batchId" in json.loads(x) for x in listener.lines)

    # events name their batch and have its events' time, and a batch that runs again leaves the same
    said = sorted((json.loads(r.payload)["key"], json.loads(r.payload)["batch"], r["at"]) for r in spark.read.json(f"{tmp_path}/topics/converted/*").collect())
    last = said[1][1]
    assert [x[:2] for x in said] == [("markdown/aa/aab.md", 0), ("markdown/cc/ccd.md", last)] and all(x[2].startswith("2024-01-01T00:00:00") for x in said)
    batch = spark.createDataFrame([("papers/cc/ccd.html", "2024-01-01 00:00:00"), ("papers/aa/aab.html", "2024-01-01 00:00:00")], "key string, at string").withColumn("at", F.col("at").cast("timestamp"))
    K.convert_batch(root, lambda e: e.join(pages, "key"))(batch, last)
    assert {(r.stem, r.batch) for r in K.markdown(spark, root).where("outcome = 'ok'").collect()} == {("aab", 0), ("ccd", last)}
    # what isn't in the batch's folder is not read: the other folder could as well be gone
    (tmp_path / "markdown/batch=0").rename(tmp_path / "elsewhere")
    events = spark.createDataFrame([("markdown/cc/ccd.md", last, "2024-01-01 00:00:00")], "key string, batch long, at string").withColumn("at", F.col("at").cast("timestamp"))
    K.index_batch(root)(events, 7)
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/points/batch=7").collect()} == {"ccd"}
