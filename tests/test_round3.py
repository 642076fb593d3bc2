"""Similar titles, blocks of pages, provider searches, heartbeats, moved files and the point table."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from scholia.operators import blocks as B
from scholia.operators import dedup as D
from scholia.sources import paper_search as P
from scholia.sources import relocate as R
from scholia.sources.point_table import PointTable, VersionTaken


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def titles_of(spark, texts):
    rows = [(f"k{i}", t, (0 if i % 3 == 0 else 1, i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "key string, title_key string, at struct<kind:int,pos:int>")


@pytest.mark.parametrize("frequent", [2000, 3])
def test_similar_titles_are_those_of_all_pairs(spark, frequent):
    r = random.Random(frequent)
    texts = []
    for _ in range(60):
        # few different grams, too: repeats of one letter, and words of two
        base = r.choice([lambda: "a" * r.randint(0, 60), lambda: "".join(r.choices("ab ", k=r.randint(1, 50))), lambda: " ".join(r.choices(["deep", "learning", "of", "graphs", "and", "text"], k=r.randint(1, 12)))])()
        texts.append(base)
        for _ in range(3):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 7))):
                k = r.randrange(len(t) + 1)
                t[k : k + r.choice([0, 1])] = r.choice(["", "x", "é"])
            texts.append("".join(t))
    texts = list(dict.fromkeys(texts))
    got = {(x.a, x.b) for x in D.similar_titles(titles_of(spark, texts), frequent=frequent).collect()}
    want = set()
    for (i, s), (j, t) in itertools.permutations(enumerate(texts), 2):
        longest = max(len(s), len(t))
        if j % 3 and ((i % 3 > 0), i) < (1, j) and abs(len(s) - len(t)) <= 0.15 * longest + 1e-9 and 1 - distance(s, t) / longest >= 0.85:
            want.add((f"k{i}", f"k{j}"))
    assert got == want and len(want) > 50


def test_candidates_grow_with_the_titles(spark):
    """Frequent grams are met in pairs: the same word in all titles brings no pairs of all of them."""
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda: "a study of " + "".join(r.choices(letters, k=40))
    counts = [D.candidate_titles(titles_of(spark, [text() for _ in range(n)]), frequent=50).count() for n in (300, 1200)]
    assert counts[1] <= 6 * max(counts[0], 20)


def test_assignments_are_the_cheapest(spark):
    r = random.Random(1)
    rows = [(k, [[r.choice([0.1, 0.2, 0.5, r.random()]) for _ in range(m)] for _ in range(n)]) for k, (n, m) in enumerate((r.randint(1, 5), r.randint(1, 5)) for _ in range(80))]
    got = spark.createDataFrame(rows, "k int, c array<array<double>>").select("k", B.cheapest_assignment(F.col("c")).alias("a")).collect()
    for k, a in got:
        c, (n, m) = rows[k][1], (len(rows[k][1]), len(rows[k][1][0]))
        used = [j for j in a if j is not None]
        assert len(set(used)) == len(used) == min(n, m)
        square = c if n <= m else list(zip(*c))
        best = min(sum(row[j] for row, j in zip(square, p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert sum(c[i][j] for i, j in enumerate(a) if j is not None) == pytest.approx(best)
    none = spark.createDataFrame([(0, [[], []]), (1, [])], "k int, c array<array<double>>").select("k", B.cheapest_assignment(F.col("c")).alias("a")).collect()
    assert {x.k: x.a for x in none} == {0: [None, None], 1: []}


def test_block_scores(spark):
    one, two, three = "the first block of this page", "another block with other words", "and what stands at the very end"
    rows = [
        (1, [one, two], [two, one]),  # the order doesn't matter
        (2, [one, two], [one]),  # half is missing
        (3, [one + two, three], [three, one, two]),  # found in two parts, which are joined
        (4, [one, two, three], [three, one + " " + two + " " + "z" * 60]),  # found inside a longer block
        (5, [one], ["qqqq jjjj"]),
        (6, [], []),
        (7, [one], None),
        (8, ["$"], ["%", ""]),
    ]
    df = spark.createDataFrame(rows, "id int, truth array<string>, found array<string>")
    got = {x.id: x for x in B.block_scores(df, ["id"]).collect()}
    plain = lambda t: len(t.replace(" ", ""))
    assert got[1].score == 100 and got[1].whole < 60
    assert got[2].score == pytest.approx(100 * plain(one) / plain(one + two))
    assert got[3].score == 100 and got[3].whole < 97
    # both true blocks are found whole in windows, which use the long block up for no one
    assert got[4].score > got[4].whole and got[4].score == pytest.approx(100 * (1 - (plain(one + two) + 60) / (plain(one + two + three) + plain(one + two) + 60)), abs=3)
    assert got[5].score == got[5].whole < 30
    assert (got[6].score, got[7].score, got[8].score) == (100, 0, 100)
    pairs = sorted((x.id, x.i, x.j) for x in B.assigned_blocks(df, ["id"]).collect())
    assert pairs[:3] == [(1, 0, 1), (1, 1, 0), (2, 0, 0)] and not [p for p in pairs if p[0] >= 5]


def _recorded(spark, tmp_path, name, days):
    from datetime import date

    from scholia.functions.dates import DateFilter
    from scholia.sources.search_urls import Search, search_url

    folder = f"file://{tmp_path}/{name}"
    bounds = DateFilter(date(2020, 1, 1), date(2021, 6, 1))
    bodies = {"openalex": lambda ds: {"results": [{"id": f"W{d}", "publication_date": d} for d in ds]}, "core": lambda ds: {"results": [{"id": k, "yearPublished": int(d[:4])} for k, d in enumerate(ds)]}}
    import json

    rows = []
    for first in (0, 2):
        url = search_url(name, "http://b", Search("q", dates=bounds, limit=2, offset=first))
        rows.append((url, json.dumps(bodies[name](days[first : first + 2]))))
    P.record(spark.createDataFrame(rows, "url string, payload string"), folder)
    return folder


def test_date_filters_go_to_the_provider(spark, tmp_path):
    from scholia.sources.providers import provider

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(P.PaperSearch)
    cond = "publication_date >= DATE '2020-01-01' AND publication_date < DATE '2021-06-01'"
    for name, days, left in (("openalex", ["2020-01-01", "2020-05-05", "2021-05-31"], False), ("core", ["2020-01-01", "2021-01-01", "2021-01-01"], True)):
        folder = _recorded(spark, tmp_path, name, days)
        rows = spark.read.format("paper_search").options(provider=name, query="q", limit=10, page_size=2, base="http://b", recorded=folder).load().where(cond)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert ("Filter (" in plan) == left, plan
        assert [x.publication_date.isoformat() for x in rows.sort("rank").collect()] == days
        assert [x["rank"] for x in rows.sort("rank").collect()] == [0, 1, 2]
        assert provider(name)(rows).count() == 3
        # another range is another address, which nothing was recorded for
        other = spark.read.format("paper_search").options(provider=name, query="q", limit=10, page_size=2, base="http://b", recorded=folder).load()
        assert other.where("publication_date >= DATE '2018-01-01' AND publication_date < DATE '2021-06-01'").count() == 0
        assert P.search(spark, name, "q", folder, 1, ">=2020 <2021-06", base="http://b", page_size="2").count() == 1


def test_pushed_ranges():
    from datetime import date

    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual, StringContains

    make = lambda name: P.SearchReader({"provider": name, "query": "q", "recorded": "file:///x", "limit": "250"})
    day = ("publication_date",)
    filters = [GreaterThan(day, date(2020, 1, 31)), LessThanOrEqual(day, date(2020, 3, 1)), IsNotNull(day), StringContains(("payload",), "x")]
    reader = make("oa")
    assert list(reader.pushFilters(filters)) == filters[3:] and (reader.after, reader.before) == (date(2020, 2, 1), date(2020, 3, 2))
    pages = reader.partitions()
    assert [p.first for p in pages] == [0, 100, 200] and "from_publication_date%3A2020-02-01" in pages[1].url.replace(":", "%3A") and "page=2" in pages[1].url
    assert list(make("s2").pushFilters(filters)) == filters
    assert list(make("arxiv").pushFilters([IsNotNull(day)])) == [IsNotNull(day)]
    reader = make("crossref")
    assert list(reader.pushFilters([EqualTo(day, date(2020, 1, 1)), GreaterThan(day, date(2020, 5, 1))])) == [] and reader.partitions() == []
    assert len(make("pmc").partitions()) == 1
    assert list(P.items_of("openalex", "no json")) == list(P.items_of("crossref", '{"message": []}')) == []
    assert list(P.items_of("arxiv", "<feed><entry><published>2020-02-03T</published></entry><entry/></feed>"))[0][1] == date(2020, 2, 3)


def test_heartbeats(spark, tmp_path):
    from scholia.streaming.heartbeat import changes

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, checkpoint = tmp_path / "beats", str(tmp_path / "check")
    os.makedirs(source)
    seen = []

    def run(number, *beats):
        lines = "".join(f'{{"service_type": "{t}", "url": "{u}", "at": "2024-01-01T00:{m:02d}:{s:02d}Z"}}\n' for t, u, m, s in beats)
        (source / f"{number}.json").write_text(lines)
        stream = spark.readStream.schema("service_type string, url string, at timestamp").json(str(source))
        found = []
        query = changes(stream).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").foreachBatch(lambda df, _: found.extend(df.collect())).start()
        query.awaitTermination()
        out = sorted((r.url, r.change, r["at"].strftime("%M:%S")) for r in found)
        seen.extend(out)
        return out

    try:
        assert run(1, ("ocr", "a", 0, 0), ("ocr", "a", 0, 0), ("ocr", "b", 0, 0)) == [("a", "registered", "00:00"), ("b", "registered", "00:00")]
        # each run starts from the checkpoint; a beats on, and a late repeat of its first beat changes nothing
        run(2, ("ocr", "a", 1, 20), ("ocr", "a", 0, 0))
        run(3, ("ocr", "a", 2, 30))
        run(4, ("ocr", "a", 3, 0))
        assert ("b", "stale", "01:30") in seen and not [x for x in seen if x[0] == "a" and x[1] != "registered"]
        run(5, ("ocr", "b", 2, 55), ("ocr", "a", 3, 10))
        assert ("b", "recovered", "02:55") in seen
        run(6, ("ocr", "c", 8, 0))
        run(7, ("ocr", "c", 8, 1))
        assert {("a", "stale", "04:40"), ("a", "reaped", "06:10"), ("b", "stale", "04:25"), ("b", "reaped", "05:55")} <= set(seen)
        assert run(8, ("ocr", "a", 8, 2)) == [("a", "registered", "08:02")]
        assert len(seen) == len(set(seen))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _drop(root, *names):
    os.makedirs(f"{root}/in", exist_ok=True)
    for n in names:
        with open(f"{root}/in/{n}", "w") as f:
            f.write("text of " + n)


@pytest.mark.parametrize("stop", ["written", "put", "told", "deleted"])
def test_a_move_that_stops_between_two_steps_runs_again(tmp_path, stop):
    root, told = f"file://{tmp_path}", []
    _drop(tmp_path, "a.pdf")

    class Stopped(Exception):
        pass

    def done(step):
        if step == stop:
            raise Stopped

    with pytest.raises(Stopped):
        R.move(root, "in/a.pdf", "papers/a/a.pdf", told.append, done)
    again = R.move(root, "in/a.pdf", "papers/a/a.pdf", told.append)
    assert again == ("relocated" if stop == "written" else "already_at_target")
    assert (tmp_path / "papers/a/a.pdf").read_text() == "text of a.pdf" and not (tmp_path / "in/a.pdf").exists()
    # a stop behind the put leaves a target that no one was told of, which catalog repair finds
    assert told == ([] if stop == "put" else ["papers/a/a.pdf"])
    assert R.move(root, "in/none", "papers/none", told.append) == "missing"


def test_moves_of_a_stream(spark, tmp_path):
    root = f"file://{tmp_path}"
    _drop(tmp_path, "a.pdf", "a copy.pdf", "b.html")
    moves = spark.createDataFrame([("in/a.pdf", "papers/a.pdf"), ("in/a copy.pdf", "papers/a.pdf"), ("in/b.html", "papers/b.html"), ("in/lost", "papers/lost")], "source string, target string")
    sink = R.relocate_sink(root, f"{root}/outcomes")
    sink(moves, 0)
    outcomes = lambda: sorted((r.source, r.outcome) for r in spark.read.parquet(f"{root}/outcomes").collect())
    assert outcomes() == [("in/a copy.pdf", "relocated"), ("in/a.pdf", "already_at_target"), ("in/b.html", "relocated"), ("in/lost", "missing")]
    assert sorted(os.listdir(tmp_path / "events")) == ["papers_a.pdf.json", "papers_b.html.json"] and os.listdir(tmp_path / "in") == []
    sink(moves, 0)
    assert [o for _, o in outcomes()] == ["already_at_target"] * 3 + ["missing"]
    # what was told of is what the stream of events reads
    from scholia.streaming.ingest import parsed

    lines = spark.read.json(f"{root}/events").withColumn("at", F.current_timestamp())
    assert sorted(r["key"] for r in parsed(lines, "ingested").collect()) == ["papers/a.pdf", "papers/b.html"]


def test_point_table(spark, tmp_path):
    table = PointTable(spark, f"file://{tmp_path}/points", 8)
    point = lambda d, k, at, v: (f"{d}:{k}", d, k, at, [float(v)])
    frame = lambda rows: spark.createDataFrame(rows, "point_id string, doc_id string, chunk_index int, indexed_at long, embedding array<float>")
    files = lambda: {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")}
    assert table.points() is None and table.version() == 0
    assert table.upsert(frame([point(f"d{i}", k, 1, i) for i in range(40) for k in range(3)])) == 1
    before, first = files(), table.manifest()
    old = table.points()
    # one document, shorter than before, and a point that is there twice
    assert table.upsert(frame([point("d7", 0, 2, 70), point("d7", 0, 3, 71)])) == 2
    after, second = files(), table.manifest()
    assert set(before) <= set(after) and all(after[f] == before[f] for f in before) and len(after) == len(before) + 1
    assert len([b for b in first if first[b] != second[b]]) == 1
    rows = {r.point_id: r.embedding[0] for r in table.points().collect()}
    assert len(rows) == 118 and rows["d7:0"] == 71 and "d7:1" not in rows
    # readers of the version before see it as it was
    assert old.count() == table.points(1).count() == 120
    assert table.delete(spark.createDataFrame([("d1",), ("nowhere",)], "doc_id string")) == 3
    assert table.points().where("doc_id = 'd1'").count() == 0 and table.points().count() == 115
    assert sorted(r.doc_id for r in table.points(docs=["d2", "d1"]).collect()) == ["d2"] * 3
    assert table.points(docs=["d2"]).inputFiles() != table.points().inputFiles() and len(table.points(docs=["d2"]).inputFiles()) == 1
    with pytest.raises(VersionTaken):
        table._commit({}, 3)
    assert table.version() == 3 and table.upsert(frame([])) == 3


def test_orphans_by_stem(spark):
    from scholia.operators.catalog import orphans_by_stem

    papers = spark.createDataFrame([(f"papers/x/{n}",) for n in ("z.pdf", "b.html", "a.pdf", "a.html", "known.pdf", "._c.pdf")], "key string")
    got = orphans_by_stem(spark.createDataFrame([("known",)], "stem string"), papers).collect()
    assert [(r.stem, r.source_ext) for r in got] == [("a", "pdf"), ("b", "html"), ("z", "pdf")]


def test_scripts_of_formulas(spark):
    from scholia.operators.evaluate import normalized_text

    cases = {r"x^\alpha y": "xalphay", r"x^{\alpha}_i": "xαi", r"\_\beta": "β", r"a^\\gamma": "aγ", r"\frac{a_1}{\sqrt{b}}": "a1b", r"\mathbf{E}\mathbf{u}_{1-x}": "Eu1x"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [r.x for r in df.select(normalized_text(F.col("t")).alias("x")).collect()] == list(cases.values())


def plain_tree_distance(a, b):
    """Zhang and Shasha's distance of two tables, over all pairs of subtrees."""

    def nodes(table):
        out, first = [], []
        for row in table:
            at = len(out)
            for cell in row:
                first.append(len(out))
                out.append(("td", *cell))
            first.append(at)
            out.append(("tr",))
        return [*out, ("table",)], [*first, 0]

    def change(x, y):
        if x[0] != y[0] or x[2:] != y[2:]:
            return 1.0
        return distance(x[1], y[1]) / max(len(x[1].encode()), len(y[1].encode()), 1) if x[0] == "td" else 0.0

    (x, lx), (y, ly) = nodes(a), nodes(b)
    dist = {}
    for i, j in itertools.product(range(len(x)), range(len(y))):
        f = {(lx[i] - 1, ly[j] - 1): 0.0}
        for p in range(lx[i], i + 1):
            f[p, ly[j] - 1] = f[p - 1, ly[j] - 1] + 1
        for q in range(ly[j], j + 1):
            f[lx[i] - 1, q] = f[lx[i] - 1, q - 1] + 1
        for p, q in itertools.product(range(lx[i], i + 1), range(ly[j], j + 1)):
            best = min(f[p - 1, q], f[p, q - 1]) + 1
            whole = (lx[p], ly[q]) == (lx[i], ly[j])
            f[p, q] = min(best, f[p - 1, q - 1] + change(x[p], y[q])) if whole else min(best, f[lx[p] - 1, ly[q] - 1] + dist[p, q])
            if whole:
                dist[p, q] = f[p, q]
    return dist[len(x) - 1, len(y) - 1]


def test_distances_of_tables(spark):
    from scholia.functions.tables import TABLES, pair_score, tree_distance

    r = random.Random(6)
    cell = lambda: (r.choice(["", "a", "ab", "abc", "xyz", "é1"]), r.choice([1, 1, 1, 2]), 1)
    table = lambda: [[cell() for _ in range(r.randint(0, 4))] for _ in range(r.randint(0, 4))]
    rows = [(i, table(), table()) for i in range(150)] + [(150, [[("a", 1, 1)] * 4], [[("a", 1, 1)] * 2] * 2), (151, [], [])]
    kind = TABLES.elementType.simpleString()
    df = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}")
    got = {x.i: (x.d, x.s) for x in df.select("i", tree_distance(F.col("a"), F.col("b")).alias("d"), pair_score(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, a, b in rows:
        want = plain_tree_distance(a, b)
        size = 1 + max(len(t) + sum(map(len, t)) for t in (a, b))
        assert got[i] == (pytest.approx(want), pytest.approx(max(0, 1 - want / size) * 100)), (a, b)
    assert got[150][0] == 3


def plain_grid(cells):
    """Place by place, with what is taken marked in a set."""
    rows = max((r for c in cells for r in c[0] or []), default=0) + 1
    cols = max((x for c in cells for x in c[1] or []), default=0) + 1
    begun = sorted(((min(c[0]), min(c[1])), i) for i, c in enumerate(cells) if c[0] and c[1])
    taken, out = set(), "<table>"
    for r in range(rows):
        out += "<tr>"
        for k in range(cols):
            if (r, k) in taken:
                continue
            own = next((cells[i] for at, i in begun if at == (r, k)), None)
            if own is None:
                out += "<td></td>"
                continue
            tag, high, wide = "th" if own[3] else "td", len(own[0]), len(own[1])
            text = (own[2] or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            out += f"<{tag}" + f' rowspan="{high}"' * (high > 1) + f' colspan="{wide}"' * (wide > 1) + f">{text}</{tag}>"
            taken |= {(r + a, k + b) for a in range(high) for b in range(wide)} - {(r, k)}
        out += "</tr>"
    return out + "</table>"


def test_grids(spark, tmp_path):
    import json

    from scholia.sources.benchmarks import CELLS, document_pairs, grid_html, grid_tables

    r = random.Random(9)
    span = lambda: list(range(k := r.randint(0, 4), k + r.choice([1, 1, 2, 3]))) if r.random() < 0.95 else r.choice([[], None])
    tables = [[(span(), span(), r.choice(["a", "b<c", "&", None]), r.choice([True, False, None])) for _ in range(r.randint(1, 9))] for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)] + [(500, []), (501, None)], f"i int, c {CELLS}")
    got = {x.i: x.h for x in df.select("i", grid_html(F.col("c")).alias("h")).collect()}
    assert got == {i: plain_grid(t) for i, t in enumerate(tables)} | {500: None, 501: None}

    for d in ("structure", "annotations", "images", "arxiv/pdf", "arxiv_ground_truth"):
        os.makedirs(tmp_path / d)
    for n in ("X_2001_page_1_table_0", "X_2001_page_1_table_1", "X_2001_page_2_table_0", "noimage_table_0"):
        (tmp_path / "structure" / f"{n}.xml").write_text("<annotation/>")
    for n in ("X_2001_page_1_table_0", "X_2001_page_1_table_1", "X_2001_page_2_table_0"):
        (tmp_path / "images" / f"{n}.jpg").write_text("x")
    cell = {"row_nums": [0], "column_nums": [0, 1], "json_text_content": "t", "is_column_header": True}
    (tmp_path / "annotations" / "X_2001_page_1_tables.json").write_text(json.dumps([{"cells": [cell]}, {"cells": []}]))
    from scholia.sources.listing import list_objects

    found = grid_tables(spark, f"{tmp_path}/structure", f"{tmp_path}/annotations", list_objects(spark, f"{tmp_path}/images")).collect()
    assert {x.id: x.table_html for x in found} == {"X_2001_page_1_table_0": '<table><tr><th colspan="2">t</th></tr></table>', "X_2001_page_1_table_1": None, "X_2001_page_2_table_0": None}
    for n in ("1.pdf", "2.pdf"):
        (tmp_path / "arxiv/pdf" / n).write_text("%PDF")
    (tmp_path / "arxiv_ground_truth/1.md").write_text("# one\n")
    assert {x.id: x.markdown for x in document_pairs(spark, str(tmp_path), ("arxiv",)).collect()} == {"arxiv:1": "# one\n", "arxiv:2": None}


def test_objects_by_key(spark, tmp_path):
    from scholia.sources.objects import clean_junk, delete_objects, look_for_objects, put_objects

    root = f"file://{tmp_path}"
    said = lambda df: sorted((r["key"], r.outcome) for r in df.collect())
    rows = spark.createDataFrame([("a/x.md", b"one"), ("a/y.md", b""), (None, b"no"), ("b.md", None)], "key string, content binary")
    assert said(put_objects(rows, root)) == [("a/x.md", "put"), ("a/y.md", "put"), ("b.md", "put")]
    assert said(put_objects(spark.createDataFrame([("a/x.md", bytearray(b"two"))], "key string, content binary"), root)) == [("a/x.md", "put")]
    assert (tmp_path / "a/x.md").read_bytes() == b"two" and sorted(os.listdir(tmp_path / "a")) == ["x.md", "y.md"]
    keys = spark.createDataFrame([("a/x.md",), ("a/x.md",), ("a/none",)], "key string")
    assert said(look_for_objects(keys, root)) == [("a/none", "missing"), ("a/x.md", "there")]
    assert said(delete_objects(keys, root)) == [("a/none", "missing"), ("a/x.md", "deleted")]
    assert said(delete_objects(keys, root)) == [("a/none", "missing"), ("a/x.md", "missing")]

    kept = [("markdown/go/good.md", b"g"), ("papers/go/good.html", b"g")]
    files = [("markdown/ju/junk.md", b"m"), ("catalog/ju/junk.yaml", b"c"), ("papers/ju/junk.htm", b"s"), *kept]
    put_objects(spark.createDataFrame(files, "key string, content binary"), root).collect()
    got = said(clean_junk(spark.createDataFrame([("junk",)], "stem string"), root))
    assert got == [("catalog/ju/junk.yaml", "deleted"), ("markdown/ju/junk.md", "deleted"), ("papers/ju/junk.htm", "deleted"), ("papers/ju/junk.html", "missing")]
    assert all((tmp_path / k).exists() for k, _ in kept)


def test_plain_latex(spark):
    from scholia.functions.latex import plain_latex

    deep = "x"
    for _ in range(40):
        deep = r"\frac{" + deep + "}{2}"
    cases = {
        r"$\mathbf{E}\mathbf{u}_{1-x}$": "Eu1-x",
        r"\frac{a}{b}": "a/b",
        r"\frac{\frac{a}{\sqrt{b}}}{c_{1}} + d": "a/b/c1 + d",
        r"\sum_{i} \alpha_i \leq \infty": "∑i αi ≤ ∞",
        r"x^\alpha": r"x\alpha",
        r"\left\{ y \right\}": " y ",
        r"\frac12": "12",
        r"\frac{a": "a/",
        r"\unknown{kept}{too} tail_": "kepttoo tail_",
        "}{": "",
        "": "",
        deep: "x" + "/2" * 40,
    }
    df = spark.createDataFrame([*cases.items(), (None, None)], "t string, want string")
    for row in df.select("t", "want", plain_latex(F.col("t")).alias("x")).collect():
        assert row.x == row.want, row
