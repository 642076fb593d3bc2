import pytest

from scholia.llm.url_filter import LISTED, address, host_and_path, judge_urls, page_links, with_rule

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


LOWER = {c: c + 32 for c in range(65, 91)}


def plain_rule(host, path, rules):
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        h = h.translate(LOWER)
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            key = (len(rule), len(h), verdict == "allow")
            best = max(best, (key, rule, verdict)) if best else (key, rule, verdict)
    return (best[1], best[2]) if best else (None, None)


URLS = [
    "http://Example.COM/en/1", "https://www.example.com/en/2", "https://m.example.com/en/", "http://example.com/EN/1", "http://a.net/es/5?x=/fr/", "http://a.net/fr", "http://net/fr/#q", "x.net/es/1",
    "ftp://b.org", "http://b.org?u=http://c.net/es/1", "http://c.net/es/://", "", None, "://", "http://", "http://notnet/es/", "HTTP://É.NET/es/é", "http://xexample.com/en/1",
]


@pytest.mark.parametrize("as_table", [False, True])
def test_rules_hold_for_hosts_and_their_subdomains(spark, as_table):
    rules = RULES + [("b.org", "block"), ("example.com/en/", "allow"), ("É.net/es/", "allow")]
    given = spark.createDataFrame(rules + rules[:1] + [(None, "block"), ("x", None)], "rule string, verdict string") if as_table else rules
    rows = [(i, u) for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    host, path = host_and_path(df.url)
    got = {r.page_id: r for r in with_rule(df.select("page_id", host.alias("host"), path.alias("path")), given).collect()}
    assert len(got) == len(URLS)
    for i, u in rows:
        rest = u.partition("://")[2] if u and "://" in u else ""
        end = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        want_host = rest[:end].translate(LOWER)
        tail = rest[end:]
        want_path = tail[: next((k for k, c in enumerate(tail) if c in "?#"), len(tail))]
        assert (got[i].host, got[i].path) == (want_host, want_path), u
        holds = got[i].holds
        assert (holds.rule if holds else None, holds.verdict if holds else None) == plain_rule(want_host, want_path, rules), u


def test_more_rules_than_an_expression_takes_are_refused(spark):
    with pytest.raises(ValueError):
        judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), [(f"h{i}.org/", "block") for i in range(LISTED + 1)])


def test_links_of_pages(spark):
    head = '<html><!-- <link rel="canonical" href="http://no.org/"> --><script>"<link rel=canonical href=http://no.org/>"</script>'
    rows = [
        ("http://a.org/x/y.html?q=1#f", head + '<link href="../z" rel="alternate CANONICAL">', "a.org/z"),
        ("http://a.org/x/", '<LINK REL=canonical HREF=//B.org?p=1&amp;r=2#t>', "b.org/?p=1&r=2"),
        ("http://a.org/x/y", "<meta http-equiv='Refresh' content='0; URL=\"/w\"'>", "a.org/w"),
        ("http://a.org/x/y", '<meta content="5;https://C.net/u" http-equiv=refresh data-content="1;url=/no">', "c.net/u"),
        ("http://a.org/x/y", '<meta http-equiv="refresh" content="30">', None),
        ("http://a.org/x/y", '<link rel="canonical" href="mailto:q@a.org"><link rel="stylesheet" href="/s">', None),
        ("http://a.org/x/y", '<link rel="canonical" href="https://A.org/x/y#top">', None),
        ("http://a.org/x/y?b", '<link rel="canonical" href="?c">', "a.org/x/y?c"),
        ("a.org/x", '<link rel="canonical" href="http://b.org/">', None),
        (None, '<link rel="canonical" href="http://b.org/">', None),
        ("http://a.org/n", None, None),
        ("http://a.org/t", "<link " * 20000 + "canonical", None),
    ]
    for url, html, want in rows:
        got = [tuple(r) for r in page_links(spark.createDataFrame([(url, html)], "url string, html string")).collect()]
        assert [b for _, b in got] == ([want] if want else []), (url, html, got)
    df = spark.createDataFrame([("HTTP://A.Org/x/./y/../z?Q#f",)], "u string")
    assert df.select(address(df.u).alias("x")).first().x == "a.org/x/z?Q"


def test_blocks_reach_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (1, "http://one.org/a", link("http://two.org/b")),  # a chain of aliases that ends at a blocked address
        (2, "https://two.org/b", '<meta http-equiv="refresh" content="0;url=http://three.org/c?s=1">'),
        (3, "http://three.org/c?s=1", link("http://bad.net/es/7")),  # never crawled itself
        (4, "http://ok.com/d", link("http://bad.net/es/7")),  # allowed by a rule of its own
        (5, "http://free.org/e", link("http://free.org/f")),  # no block in its component
        (6, "http://three.org/c", ""),  # another address
        (6, "http://one.org/a#x", ""),  # a repeated id, and the same address
        (None, "http://four.org/", None),  # tied by the table of redirects
        (8, None, link("http://bad.net/es/7")),
    ] + [(100 + i, f"http://hub.org/{i}", link("http://hub.org/")) for i in range(300)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, rule int")
    redirects = spark.createDataFrame([("http://four.org", "http://hub.org/"), ("http://four.org/", "http://four.org/#same"), ("http://x.net/fr/", "https://four.org/"), (None, "http://four.org/")], "from_url string, to_url string")
    got = judge_urls(df, RULES, redirects).collect()
    assert len(got) == len(pages) and got[0].asDict().keys() == {"page_id", "host", "path", "rule", "verdict", "passed_on"}
    blocked = sorted((r.page_id if r.page_id is not None else -1, r.passed_on) for r in got if r.verdict == "block")
    assert blocked == [(-1, True), (1, True), (2, True), (3, True), (6, True)] + [(100 + i, True) for i in range(300)]
    assert [(r.rule, r.verdict, r.passed_on) for r in got if r.page_id == 4] == [("com/", "allow", False)]
    # without the table the hub is no alias of a blocked address
    assert sum(r.verdict == "block" for r in judge_urls(df, RULES).collect()) == 4
    assert judge_urls(df.limit(0), RULES).count() == 0


def test_components_against_a_plain_walk(spark):
    import random

    r = random.Random(5)
    name = lambda k: f"http://h{k % 7}.{'net/es' if k % 41 == 0 else 'org/p'}/{k}"
    links = [(r.randrange(400), r.randrange(400)) for _ in range(220)]
    pages = spark.createDataFrame([(k, name(k), "".join(f'<link rel="canonical" href="{name(b)}">' for a, b in links if a == k)) for k in range(400)], "page_id long, url string, html string")
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    bad = {find(k) for k in range(0, 400, 41)}
    got = {x.page_id: x.verdict for x in judge_urls(pages, RULES).collect()}
    assert got == {k: "block" if find(k) in bad else "allow" for k in range(400)}
