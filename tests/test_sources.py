import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scholia.sources import providers as P
from scholia.sources.inbox import classified, sweep_report
from scholia.sources.listing import list_objects, read_catalog, read_markdown, resolved_keys
from scholia.streaming import ingest

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A
  title</title><summary> Some text. </summary><published>2024-01-05T00:00:00Z</published><author><name>Ann B</name></author><author><name>Cy D</name></author>
<link href="http://arxiv.org/abs/2401.00001v2" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/2401.00001v2"/><arxiv:doi>10.1/x</arxiv:doi></entry></feed>"""


def one(spark, mapper, payload):
    df = spark.createDataFrame([(payload if isinstance(payload, str) else json.dumps(payload),), ("not json",)], "payload string")
    return mapper(df).collect()


def test_openalex(spark):
    work = {"id": "https://openalex.org/W1", "display_name": "T", "doi": "https://doi.org/10.1/x", "publication_date": "2020-02-03", "cited_by_count": 7, "abstract_inverted_index": {"b": [1], "a": [0]},
            "authorships": [{"author": {"display_name": "N"}, "institutions": [{"display_name": "U"}, {"display_name": None}]}], "best_oa_location": {"pdf_url": "p1"}, "open_access": {"oa_url": "p2"}, "locations": [{"pdf_url": "p1"}, {"pdf_url": "p3"}, {}]}
    (r,) = one(spark, P.openalex, work)
    assert (r.id, r.title, r.abstract_text, r.doi, r.publication_date, r.download_urls, r.cited_by_count) == ("W1", "T", "a b", "10.1/x", date(2020, 2, 3), ["p1", "p2", "p3"], 7)
    assert r.authors[0].name == "N" and r.authors[0].affiliations == ["U"]


@pytest.mark.parametrize("ids,doi", [({"DOI": "10.1/x", "ArXiv": "1"}, "10.1/x"), ({"ArXiv": "2401.1"}, "10.48550/arXiv.2401.1"), ({"DOI": " "}, None), (None, None)])
def test_semantic_scholar(spark, ids, doi):
    (r,) = one(spark, P.semantic_scholar, {"paperId": "s", "title": "T", "year": 2019, "citationCount": 3, "authors": [{"name": "N"}], "externalIds": ids, "openAccessPdf": {"url": "u"}})
    assert (r.doi, r.publication_date, r.download_urls, r.cited_by_count) == (doi, date(2019, 1, 1), ["u"], 3)


def test_others(spark):
    (r,) = one(spark, P.europe_pmc, {"id": "1", "title": "T", "authorString": "A B, C D.", "firstPublicationDate": "2020-01-02", "citedByCount": 1})
    assert [a.name for a in r.authors] == ["A B", "C D"] and r.publication_date == date(2020, 1, 2)
    (r,) = one(spark, P.crossref, {"DOI": "10.1/x", "title": ["T"], "author": [{"given": "A", "family": "B"}], "published": {"date-parts": [[2020, 5]]}, "is-referenced-by-count": 4, "link": [{"URL": "u", "content-type": "application/pdf"}, {"URL": "v", "content-type": "text/html"}]})
    assert (r.publication_date, r.authors[0].name, r.download_urls, r.cited_by_count) == (date(2020, 5, 1), "A B", ["u"], 4)
    (r,) = one(spark, P.core, {"id": 5, "title": "T", "yearPublished": 2001, "downloadUrl": ""})
    assert (r.id, r.publication_date, r.download_urls, r.cited_by_count) == ("5", date(2001, 1, 1), [], None)
    (r,) = one(spark, P.arxiv, ATOM)
    assert (r.id, r.title, r.abstract_text, r.doi, r.publication_date, r.download_urls) == ("2401.00001", "A title", "Some text.", "10.1/x", date(2024, 1, 5), ["http://arxiv.org/pdf/2401.00001v2"])
    assert [a.name for a in r.authors] == ["Ann B", "Cy D"]


def test_names():
    assert P.provider("S2") is P.semantic_scholar and P.provider("pmc") is P.europe_pmc
    with pytest.raises(ValueError):
        P.provider("nope")


def test_files(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / "abc.md").write_text("# One\n\n---\n\ntwo")
    (tmp_path / "._x.md").write_text("no")
    (tmp_path / "q.pdf").write_bytes(b"%PDF" + b"x" * 200)
    assert list_objects(spark, str(tmp_path)).count() == 2  # Spark lists no hidden files
    (r,) = read_markdown(spark, str(tmp_path)).collect()
    assert (r.stem, r.markdown) == ("abc", "# One\n\n---\n\ntwo")
    (tmp_path / "c.json").write_text('{"stem":"s","conversion":{"duration_secs":3,"total_pages":1}}\n{"stem":\n{"title":"x"}\n')
    (c,) = read_catalog(spark, str(tmp_path / "c.json")).collect()
    assert c.conversion.duration_secs == 3.0 and c.embedding is None
    cat = spark.createDataFrame([("abc", "m/abc.md"), ("xyz", "gone.md"), ("pqr", None)], "stem string, markdown_path string")
    have = spark.createDataFrame([("m/abc.md",)], "key string")
    assert {r.stem: r.key for r in resolved_keys(cat, have, "m").collect()} == {"abc": "m/abc.md", "xyz": "m/xy/xyz.md", "pqr": "m/pq/pqr.md"}


def test_inbox(spark):
    now = datetime(2024, 1, 1, 12)
    old, new = now - timedelta(hours=1), now - timedelta(seconds=2)
    p = "papers/manually_downloaded/"
    rows = [(p + "a b.pdf", old, "commit", "papers/a /a b.pdf"), (p + "book.EPUB", old, "commit", "papers/bo/book.html"), (p + "x.download", old, "ignored_unsupported", None), (p + "y.pdf", new, "still_writing", None), ("papers/zz/y.pdf", old, "ignored_non_inbox", None), (p + "._z.pdf", old, "ignored_unsupported", None), (p + "noext", old, "ignored_unsupported", None), (p + "t.txt", old, "ignored_unsupported", None)]
    df = spark.createDataFrame([(k, t, 1) for k, t, *_ in rows], "key string, last_modified timestamp, size bigint")
    got = classified(df, F.lit(now))
    assert {r.key: (r.outcome, r.target_key) for r in got.collect()} == {k: (o, t) for k, _, o, t in rows}
    assert sum(r.n for r in sweep_report(got).collect()) == len(rows)


def test_stream_of_events(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    line = lambda key, s: json.dumps({"subject": "papers.ingested", "payload": json.dumps({"key": key}) if key else "{bad", "at": f"2024-01-01T00:00:{s:02d}Z"})
    (inbox / "1.json").write_text("\n".join([line("a", 1), line("b", 2), line("a", 3), line(None, 4), json.dumps({"subject": "other", "payload": "{}", "at": "2024-01-01T00:00:05Z"})]))
    seen = []

    def run():
        rows = ingest.without_repeats(ingest.parsed(ingest.events(spark, str(inbox)), "papers.ingested"))
        q = ingest.run_to(rows, str(tmp_path / "ck"), lambda df, n: seen.extend(r.key for r in df.collect()))
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    assert sorted(seen) == ["a", "b"]
    # a restart goes on behind what was done
    (inbox / "2.json").write_text("\n".join([line("b", 6), line("c", 7)]))
    run()
    assert sorted(seen) == ["a", "b", "c"]


def test_conversion(spark):
    good = "<article><p>" + "</p><p>".join(f"Sentence {i} says something else entirely {i * 7}." for i in range(40)) + "</p></article>"
    loop = "<article>" + "".join(f"<p>{'w%d ' % i * 9}</p>" for i in range(30)) + "</article>"
    df = spark.createDataFrame([("a", good, None), ("b", good, 0.2), ("c", "<p>x</p>", None), ("d", loop, None)], "key string, html string, duration double")
    assert {r.key: r.outcome for r in ingest.converted(df).collect()} == {"a": "ok", "b": "stub", "c": "stub", "d": "repetition_loop"}
