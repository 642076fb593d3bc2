"""URL rules, whose blocks reach all addresses that redirects and canonical links make one page.

Addresses that a redirect or a canonical link ties together name the same page, so a
block of one is a block of all in its connected component.  The links are read from the
pages themselves (<link rel="canonical">, <meta http-equiv="refresh">) and from a table of
redirects where there is one.  An address with a rule of its own keeps that rule's verdict:
an explicit allow comes before any block that is passed on.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.components import components
from scholia.llm.staging import forget, staged

#: Rules that a list may have; they become one expression.  More come as a table.
LISTED = 256

Rules = Sequence[tuple[str, str]] | DataFrame

_COMMENT_OR_CODE = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|noscript)\b.*?(?:</\1\s*>|\z)"
#: Outside of quotes "<" ends a tag that isn't closed, so that broken pages take linear time.
_TAG = r"(?i)<(?:link|meta)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>"


def _lower(text: Column) -> Column:
    """Only A to Z."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty where it is null or has no "://"."""
    begin = F.locate("://", url)
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    host = _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), slash + path


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def _listed(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The rule that holds, as struct (rule, verdict), from one expression."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # the longest comes first, then the longer host, and allow before block
    order = sorted(set(rules), key=lambda r: (-len(r[0]), -len(_parts(r[0])[0]), r[1]))
    for rule, verdict in reversed(order):
        own = [F.lit(x) for x in _parts(rule)]
        found = F.when(_fits(host, path, *own), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def with_rule(urls: DataFrame, rules: Rules) -> DataFrame:
    """Rows with columns host and path, and the rule that holds for them, in a struct `holds` (rule, verdict) or null.

    A list of rules becomes an expression, without a shuffle.  A table (rule, verdict) is met
    on the parent domains of the different addresses, by an equi-join at every size.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) > LISTED:
            raise ValueError(f"more than {LISTED} rules are given as a table")
        return urls.withColumn("holds", _listed(F.col("host"), F.col("path"), rules))
    text = F.col("rule")
    host = _lower(F.regexp_extract(text, "^[^/]*", 0))
    table = rules.where("rule IS NOT NULL AND verdict IN ('allow', 'block')").distinct().select(
        "rule", "verdict", host.alias("rule_host"), F.regexp_extract(text, "(?s)^[^/]*(.*)$", 1).alias("rule_path")
    )
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    seen = urls.select("host", "path").distinct().withColumn("rule_host", F.explode(parents))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rule_host"), F.col("verdict") == "allow"))
    fitting = seen.join(table, "rule_host").where("startswith(path, rule_path)").groupBy("host", "path").agg(best.alias("holds"))
    return urls.join(fitting, ["host", "path"], "left")


def _attribute(tag: Column, name: str) -> Column:
    own = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    value = F.concat(*[F.regexp_extract(tag, own, i) for i in (1, 2, 3)])
    return F.trim(F.regexp_replace(value, r"&(?:amp|#38|#x26);", "&"))


def _without_dots(path: Column) -> Column:
    """The path without "." and ".." steps."""
    steps = F.split(path, "/")
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    ends = path.rlike(r"/\.\.?$")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.array_join(kept, "/"), F.when(ends, "/").otherwise(""))).otherwise(path)


def _address(rest: Column) -> Column:
    """What stands behind "://" as one address: host lower-cased, path at least "/", query kept, fragment dropped."""
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(_without_dots(path))
    return F.concat(_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), path, F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1))


def address(url: Column) -> Column:
    """The address that an absolute url names, whatever its scheme and fragment; null without "://"."""
    begin = F.locate("://", url)
    return F.when(begin > 0, _address(F.substring(url, begin + 3, F.length(url))))


def _resolved(target: Column, base: Column) -> Column:
    """The address of a link on the page with the address `base`; null for other schemes and for itself."""
    host, path = F.regexp_extract(base, "^[^/]*", 0), F.regexp_extract(base, r"^[^/]*([^?]*)", 1)
    return (
        F.when(target.rlike(r"^(?i)https?://"), address(target))
        .when(F.startswith(target, F.lit("//")), _address(F.substring(target, 3, F.length(target))))
        .when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | target.rlike(r"^(?:#|$)"), F.lit(None))
        .when(F.startswith(target, F.lit("/")), _address(F.concat(host, target)))
        .when(F.startswith(target, F.lit("?")), _address(F.concat(host, path, target)))
        .otherwise(_address(F.concat(host, F.regexp_replace(path, "[^/]*$", ""), target)))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): the addresses that a page's canonical link or its refresh ties to its own."""
    clean = F.regexp_replace(F.col(html_col), _COMMENT_OR_CODE, " ")
    tags = F.when(F.col(html_col).rlike("(?i)canonical|refresh"), F.regexp_extract_all(clean, F.lit(_TAG), F.lit(0)))
    found = pages.select(address(F.col(url_col)).alias("a"), F.explode(tags).alias("tag")).where("a IS NOT NULL")
    tag = F.col("tag")
    canonical = tag.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = tag.rlike("(?i)^<meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
    onward = F.trim(F.regexp_extract(_attribute(tag, "content"), r"(?i)^\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?['\"]?([^'\"]*)", 1))
    target = F.when(canonical, _attribute(tag, "href")).when(refresh, onward)
    return found.select("a", _resolved(target, F.col("a")).alias("b")).where("b IS NOT NULL AND a <> b")


def _key(node: Column) -> Column:
    """128 bits of an address, so that components don't carry the addresses themselves."""
    return F.md5(node)


def judge_urls(
    pages: DataFrame, rules: Rules, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html"
) -> DataFrame:
    """page_id, host, path, rule, verdict and passed_on (boolean) for every row.

    A rule `host/path` fits its host and all subdomains if the path begins with the rule's;
    the longest fitting rule holds, and of one text that is both, allow.  A page without a
    rule is blocked if a redirect or canonical link, over any number of steps, ties it to an
    address that a rule blocks, crawled or not; passed_on says so.  All others are allowed.

    `redirects` (from_url, to_url) are links besides those of the pages; html_col may be
    None.  Null urls, and those without "://", have an empty host and path and no links.
    Null ids and repeated rows are kept as they are, other columns are ignored, and an empty
    table gives an empty result.  Links to the page itself, to other schemes and repeated
    links change nothing.
    """
    host, path = host_and_path(F.col(url_col))
    judged = with_rule(pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), address(F.col(url_col)).alias("node")), rules)
    links = [page_links(pages, url_col, html_col)] if html_col else []
    if redirects is not None:
        links.append(redirects.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b")).where("a <> b"))
    rows = judged.select("page_id", "host", "path", "holds.rule", "holds.verdict", _key(F.col("node")).alias("id"))
    if links:
        both = links[0] if len(links) == 1 else links[0].unionByName(links[1])
        tied = staged(both.distinct(), "page-links")
        blocked = _passed_on(tied, rules)
        forget(tied)
        rows = rows.join(blocked, "id", "left")
    else:
        rows = rows.withColumn("blocked", F.lit(None).cast("boolean"))
    passed_on = F.col("rule").isNull() & F.coalesce("blocked", F.lit(False))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(passed_on, "block").otherwise("allow")).alias("verdict"), passed_on.alias("passed_on"))


def _passed_on(links: DataFrame, rules: Rules) -> DataFrame:
    """(id, blocked): every address in a component of the links (a, b) in which a rule blocks one."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    urls = ends.select(_key(F.col("node")).alias("id"), F.regexp_extract("node", "^[^/]*", 0).alias("host"), F.regexp_extract("node", r"^[^/]*([^?]*)", 1).alias("path"))
    # a block of one address is enough, so the components of unblocked addresses are never walked twice
    bad = with_rule(urls, rules).where("holds.verdict = 'block'").select("id")
    roots = components(links.select(_key(F.col("a")).alias("a"), _key(F.col("b")).alias("b")))
    hit = roots.join(bad, "id").select("root").distinct()
    return staged(roots.join(hit, "root").select("id", F.lit(True).alias("blocked")), "blocked")
