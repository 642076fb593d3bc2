"""Registered queries of scoring, repetition and duplicates, each with its SQL below it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions.repetition import looping
from scholia.operators import blocks as B
from scholia.operators import evaluate as E
from scholia.plans import views
from scholia.plans.more_oracle import _PAIRS
from scholia.plans.oracle import _relevance, _with
from scholia.plans.queries import QUERIES, _pairs, _r, query
from scholia.plans.views import table

SCORING: dict[str, str] = {}


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's letters and digits, and the first half of them with the second half of the next turn's, which some turns lack."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]", "")
    rows = views.dealt(table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn", text.alias("t"))
    after = F.coalesce(F.lead("t").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    half = lambda c: F.call_function("div", F.length(c), F.lit(2)).cast("int")
    mixed = F.concat(F.substring("t", F.lit(1), half(F.col("t"))), F.substring(after, half(after) + 1, F.length(after)))
    return rows.select("conv_id", "turn", "t", F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, mixed).alias("f"))


def _block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("turn", c)))), lambda x: x[c])
    return _turns(spark, sf_dir).groupBy("conv_id").agg(held("t").alias("truth"), held("f").alias("found"))


@query
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.assigned_blocks(_block_pages(spark, sf_dir), ["conv_id"]).select("conv_id", "i", "j", _r(F.col("ned"), "ned"))


_BLOCKS = r"""r AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g') AS t FROM conversations),
x AS (SELECT conv_id, turn, t, coalesce(lead(t) OVER (PARTITION BY conv_id ORDER BY turn), '') AS n FROM r),
y AS (SELECT conv_id, turn, t, CASE WHEN (conv_id + turn) % 5 <> 0 THEN substr(t, 1, len(t) // 2) || substr(n, len(n) // 2 + 1) END AS f FROM x),
a AS (SELECT conv_id, t, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS i FROM y WHERE t <> ''),
b AS (SELECT conv_id, f, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS j FROM y WHERE f <> ''),
c AS (SELECT a.conv_id, i, j, levenshtein(t, f) * 1.0::DOUBLE / greatest(len(t), len(f)) AS ned FROM a JOIN b USING (conv_id)),
s AS (SELECT conv_id, max(i) + 1 AS n, max(j) + 1 AS m FROM c GROUP BY conv_id)"""

# the cheapest way to every set of found blocks, row by row
SCORING["block_pairs"] = rf"""WITH RECURSIVE {_BLOCKS},
w(conv_id, i, used, cost, way) AS (
  SELECT conv_id, 0, CAST(0 AS BIGINT), 0.0::DOUBLE, CAST([] AS INTEGER[]) FROM s
  UNION ALL
  SELECT conv_id, any_value(i) + 1, used, min(cost), arg_min(way, cost) FROM (
    SELECT w.conv_id, w.i, w.used | (CAST(1 AS BIGINT) << c.j) AS used, w.cost + c.ned AS cost, list_append(w.way, c.j) AS way
      FROM w JOIN c ON c.conv_id = w.conv_id AND c.i = w.i WHERE (w.used >> c.j) & 1 = 0
    UNION ALL
    SELECT w.conv_id, w.i, w.used, w.cost, list_append(w.way, -1) FROM w JOIN s USING (conv_id) WHERE w.i < s.n AND s.n > s.m AND w.i - bit_count(w.used) < s.n - s.m)
  GROUP BY conv_id, used),
best AS (SELECT conv_id, arg_min(way, cost) AS way FROM w JOIN s USING (conv_id) WHERE w.i = s.n AND bit_count(w.used) = least(s.n, s.m) GROUP BY conv_id),
p AS (SELECT conv_id, CAST(unnest(range(0, len(way))) AS INTEGER) AS i, unnest(way) AS j FROM best)
SELECT conv_id, i, j, round(ned, 6) AS ned FROM p JOIN c USING (conv_id, i, j) WHERE ned <= 0.7"""


@query
def block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.block_scores(_block_pages(spark, sf_dir), ["conv_id"]).select("conv_id", _r(F.col("whole"), "whole"), _r(F.col("score"), "score"))


@query
def formula_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as formulas against those of the next one."""
    latex = F.concat(F.lit("$\\mathbf{"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]", ""), F.lit("}$"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.substring(latex, 1, 60).alias("x")))).alias("f"))
    of = rows.select("conv_id", F.transform("f", lambda x: x["x"]).alias("truth"))
    pages = of.join(of.select((F.col("conv_id") - 1).alias("conv_id"), F.col("truth").alias("found")), "conv_id")
    return E.formula_scores(pages, ["conv_id"]).select("conv_id", _r(F.col("cdm"), "cdm"))


SCORING["formula_pairs"] = r"""WITH RECURSIVE l AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS i,
    lower(regexp_replace(replace(substr('$\mathbf{' || regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g') || '}$', 1, 60), '\mathbf', ''), '^\$+|\$+$', '', 'g')) AS x FROM conversations),
k AS (SELECT conv_id, i, x, unnest(string_split(x, '')) AS c FROM l),
n AS (SELECT conv_id, i, c, count(*) AS n FROM k GROUP BY ALL),
p AS (SELECT a.conv_id, a.i, b.i AS j, length(a.x) + length(b.x) AS size, coalesce((SELECT sum(least(u.n, v.n)) FROM n u JOIN n v ON u.c = v.c WHERE u.conv_id = a.conv_id AND u.i = a.i AND v.conv_id = b.conv_id AND v.i = b.i), 0) AS common
  FROM l a JOIN l b ON b.conv_id = a.conv_id + 1),
s AS (SELECT conv_id, i, j, least(200.0::DOUBLE * common / size, 100) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY least(200.0::DOUBLE * common / size, 100) DESC, i, j) AS k FROM p),
w(conv_id, k, ui, uj, total) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS INTEGER[]), 0.0::DOUBLE FROM s
  UNION ALL
  SELECT w.conv_id, s.k, CASE WHEN f THEN list_append(ui, s.i) ELSE ui END, CASE WHEN f THEN list_append(uj, s.j) ELSE uj END, total + CASE WHEN f THEN s.s ELSE 0 END
  FROM w JOIN s ON s.conv_id = w.conv_id AND s.k = w.k + 1, LATERAL (SELECT NOT list_contains(ui, s.i) AND NOT list_contains(uj, s.j) AS f))
SELECT conv_id, round(arg_max(total, k) / (SELECT count(*) FROM l WHERE l.conv_id = w.conv_id), 6) AS cdm FROM w GROUP BY conv_id"""


@query
def eval_run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with text, a formula and a table for some; every seventh failed, and others lost half of the text or the table."""
    i = F.col("doc_id")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "")
    html = F.concat(F.lit("<table><tr><td>"), i.cast("string"), F.lit("</td><td>x</td></tr></table>"))
    latex = F.concat(F.lit("$x_{"), i.cast("string"), F.lit("}$"))
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(
        i.alias("id"),
        F.when(i % 11 != 0, F.substring(text, 1, 400)).otherwise("").alias("text"),
        F.when(i % 3 == 0, F.array(latex, F.concat(latex, F.lit("+1")))).otherwise(F.array().cast("array<string>")).alias("formula"),
        F.when(i % 2 == 0, html).otherwise("").alias("tables"),
    )
    good = lambda c: F.when(F.col("id") % 7 != 0, c)
    half = F.when(F.col("id") % 5 == 0, F.substring("text", F.lit(1), F.call_function("div", F.length("text"), F.lit(2)).cast("int"))).otherwise(F.col("text"))
    lost = F.when(F.col("id") % 13 == 0, F.slice("formula", 1, 1)).otherwise(F.col("formula"))
    pages = rows.select("*", good(half).alias("found_text"), good(lost).alias("found_formula"), good(F.when(F.col("id") % 4 != 0, F.col("tables")).otherwise("")).alias("found_tables"))
    out = E.scored_pages(pages)
    mean = lambda c: _r(F.coalesce(F.avg(c), F.lit(0.0)), f"mean_{c}")
    return out.groupBy("failed").agg(F.count(F.lit(1)).alias("n_pages"), *[F.count(c).alias(f"n_{c}") for c in ("text", "table", "formula")], *map(mean, ("ned", "text", "table", "formula", "composite")))


SCORING["eval_run_means"] = r"""WITH p AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN substr(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g'), 1, 400) ELSE '' END AS text, doc_id % 7 = 0 AS failed FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT id, failed, text, replace(text, ' ', '') AS a, replace(CASE WHEN id % 5 = 0 THEN substr(text, 1, len(text) // 2) ELSE text END, ' ', '') AS b FROM p),
m AS (SELECT id, failed, trim(text) <> '' AS has, CASE WHEN failed THEN 1 WHEN a = '' THEN 0 ELSE levenshtein(a, b) * 1.0::DOUBLE / greatest(len(a), len(b)) END AS ned,
  CASE WHEN NOT failed AND id % 2 = 0 THEN CASE WHEN id % 4 <> 0 THEN 100.0 ELSE 0.0 END END AS tab,
  CASE WHEN NOT failed AND id % 3 = 0 THEN CASE WHEN id % 13 = 0 THEN 50.0 ELSE 100.0 END END AS formula FROM t),
s AS (SELECT *, CASE WHEN NOT failed THEN (1 - ned) * 100 WHEN has THEN 0.0 END AS text FROM m),
c AS (SELECT *, CASE WHEN failed THEN 0 ELSE coalesce(list_avg(list_filter([CASE WHEN has OR (tab IS NULL AND formula IS NULL) THEN text END, tab, formula], lambda x: x IS NOT NULL)), 0) END AS composite FROM s)
SELECT failed, count(*) AS n_pages, count(text) AS n_text, count(tab) AS n_table, count(formula) AS n_formula, round(avg(ned), 6) AS mean_ned, round(coalesce(avg(text), 0), 6) AS mean_text,
  round(coalesce(avg(tab), 0), 6) AS mean_table, round(coalesce(avg(formula), 0), 6) AS mean_formula, round(avg(composite), 6) AS mean_composite FROM c GROUP BY failed"""


#: Letters of the texts beyond ASCII, and marks that stand for them where SQL counts bytes.
_LETTERS, _MARKS = "ÉÈÊÇÄÖÜßéèêçäöüñáíóúÑÁÍÓÚ", "!#$%&()*+,-./:;<=>?@[]^_{"


@query
def ned_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they are, letters beyond ASCII included."""
    return _pairs(spark, sf_dir).select("item_id", _r(E.page_ned(F.col("text"), F.col("hyp")), "ned"))


def _plain_letters(c: str) -> str:
    return f"translate({c}, '{_LETTERS}', '{_MARKS}')"


SCORING["ned_letters"] = rf"""WITH {_PAIRS}, n AS (SELECT item_id, regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g') AS a, regexp_replace(hyp, '[^\p{{L}}\p{{N}}]', '', 'g') AS b FROM pairs)
SELECT item_id, round(levenshtein({_plain_letters('a')}, {_plain_letters('b')}) * 1.0::DOUBLE / greatest(strlen(a), strlen(b)), 6) AS ned FROM n"""


@query
def repetition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with loops, with the place of the first; each third has one more put at its end."""
    i = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(i % 3 == 0, F.concat(F.lit("\nz"), F.repeat(F.lit(" loop of words here"), 5))).otherwise(""))
    docs = views.spread(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    return looping(docs, 0, "doc_id", "text").select("doc_id", F.col("sites").cast("long").alias("sites"))


def _loops(text: str) -> str:
    """CTEs up to `cut3` (doc_id, sites, text): the passes of repetition, as islands of places whose unit follows itself."""
    out = [
        f"d AS (SELECT doc_id, {text} AS text FROM documents)",
        "ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM d WHERE text <> '')",
        "ci AS (SELECT doc_id, c, i, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS run FROM ch)",
        "cn AS (SELECT doc_id, c, min(i) AS i, count(*) AS n FROM ci GROUP BY doc_id, c, run)",
        "cut0 AS (SELECT doc_id, string_agg(CASE WHEN n > 10 THEN c ELSE repeat(c, n) END, '' ORDER BY i) AS text, count(*) FILTER (n > 10) AS sites FROM cn GROUP BY doc_id)",
        "ln0 AS (SELECT doc_id, sites, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM cut0)",
        r"w0 AS (SELECT doc_id, k, regexp_extract_all(line, '[^\s]+') AS w, line FROM ln0)",
    ]
    for p, (n, most) in enumerate(((4, 3), (2, 4), (1, 5)), 1):
        same = " AND ".join(f"w[i + {k}] = w[i + {n + k}]" for k in range(n))
        out += [
            f"e{p} AS (SELECT doc_id, k, i FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - {2 * n} + 2)) AS i FROM w{p - 1} WHERE len(w) >= {2 * n}) WHERE {same})",
            f"i{p} AS (SELECT doc_id, k, min(i) AS i, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS run FROM e{p}) GROUP BY doc_id, k, run HAVING (count(*) + {n - 1}) // {n} + 1 > {most})",
            f"g{p} AS (SELECT doc_id, k, count(*) AS sites, list(struct_pack(a := i + {n}, b := i + {n} * ((n + {n - 1}) // {n} + 1))) AS cuts FROM i{p} GROUP BY doc_id, k)",
            f"w{p} AS (SELECT w{p - 1}.doc_id, w{p - 1}.k, line, CASE WHEN cuts IS NULL THEN w ELSE list_filter(w, lambda x, i: len(list_filter(cuts, lambda c: i >= c.a AND i < c.b)) = 0) END AS w FROM w{p - 1} LEFT JOIN g{p} USING (doc_id, k))",
        ]
    sites = " UNION ALL ".join(["SELECT doc_id, sites FROM cut0", *[f"SELECT doc_id, sites FROM g{p}" for p in (1, 2, 3)]])
    out += [
        "lines AS (SELECT w3.doc_id, k, CASE WHEN len(w0.w) >= 2 THEN array_to_string(w3.w, ' ') ELSE w3.line END AS line FROM w3 JOIN w0 USING (doc_id, k))",
        f"sites AS (SELECT doc_id, CAST(sum(sites) AS BIGINT) AS sites FROM ({sites}) GROUP BY doc_id)",
        "cut3 AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM lines GROUP BY doc_id)",
    ]
    return "WITH " + ",\n".join(out)


SCORING["repetition_scan"] = _loops("text") + "\nSELECT doc_id, coalesce(sites, 0) AS sites, length(coalesce(cut3.text, '')) AS clean_chars FROM d LEFT JOIN cut3 USING (doc_id) LEFT JOIN sites USING (doc_id)"
SCORING["repetition_report"] = _loops("coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'z' || repeat(' loop of words here', 5) ELSE '' END") + "\nSELECT doc_id, sites FROM sites WHERE sites > 0"


def _greedy(condition: str, ends: str) -> str:
    """CTEs to `grouped`: papers with the key of the first earlier title that leads and is alike."""
    letters = "translate(x, 'àáâäãåæçéèêëíìîïñóòôöõøœúùûüýÿß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&')"
    return (
        _with("papers", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
        + rf""", rows AS (SELECT *, lower(replace(doi, 'https://doi.org/', '')) AS doi_key, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\S+'), lambda w: w NOT IN ('the', 'a', 'an')), ' ') AS tk FROM papers WHERE {condition}),
placed AS (SELECT *, coalesce('d:' || doi_key, 't:' || tk) AS key, row_number() OVER (ORDER BY weight DESC, rank, id) AS pos FROM rows),
lead AS (SELECT key, CASE WHEN starts_with(key, 'd:') THEN 0 ELSE 1 END AS kind, arg_min(tk, pos) AS tk, min(pos) AS pos FROM placed GROUP BY key),
num AS (SELECT *, row_number() OVER (ORDER BY kind, pos) AS n, length(tk) AS size, {letters.replace("x,", "tk,")} AS flat FROM lead),
near AS (SELECT a.n AS a, b.n AS b FROM num a JOIN num b ON b.kind = 1 AND a.n < b.n AND least(a.size, b.size) >= 0.85 * greatest(a.size, b.size) - 1e-9
  WHERE greatest(a.size, b.size) = 0 OR 1 - levenshtein(a.flat, b.flat) * 1.0::DOUBLE / greatest(a.size, b.size) >= 0.85),
cand AS (SELECT b, list(a ORDER BY a) AS al, row_number() OVER (ORDER BY b) AS k FROM near GROUP BY b),
walk(k, f) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT cand.k, CASE WHEN len(list_filter(al, lambda x: NOT list_contains(f, x))) > 0 THEN list_append(f, b) ELSE f END FROM walk JOIN cand ON cand.k = walk.k + 1),
fin AS (SELECT arg_max(f, k) AS f FROM walk),
led AS (SELECT num.key, num.pos AS first_pos, CASE WHEN list_contains(fin.f, num.n) THEN list_filter(al, lambda x: NOT list_contains(fin.f, x))[1] ELSE num.n END AS g FROM num LEFT JOIN cand ON cand.b = num.n, fin),
grouped AS (SELECT placed.*, num.key AS group_key, CASE WHEN placed.pos = first_pos THEN CASE WHEN placed.key = num.key THEN 'none' ELSE 'fuzzy' END WHEN doi_key IS NOT NULL THEN 'doi' ELSE 'fuzzy' END AS match_type
  FROM placed JOIN led USING (key) JOIN num ON num.n = led.g)
{ends}"""
    )


SCORING["fuzzy_dedup"] = _greedy("true", "SELECT id, group_key, match_type FROM grouped")
SCORING["dedup_counts"] = _greedy(
    "true", "SELECT count(*) AS total_raw, count(DISTINCT group_key) AS unique, count(*) FILTER (match_type = 'doi') AS doi_matches, count(*) FILTER (match_type = 'fuzzy') AS fuzzy_matches FROM grouped"
)
SCORING["metasearch_top"] = _greedy(
    "publication_date >= DATE '2015-01-01'",
    rf""", merged AS (SELECT group_key, arg_min(id, pos) AS id, arg_max(title, strlen(title) * 1000000000 + pos) AS title, arg_max(abstract_text, strlen(abstract_text) * 1000000000 + pos) AS abstract_text,
  arg_min(publication_date, pos) FILTER (publication_date IS NOT NULL) AS publication_date, arg_min(doi, pos) FILTER (doi IS NOT NULL) AS doi, max(cited_by_count) AS cited_by_count,
  array_to_string(list_sort(list(DISTINCT source)), '+') AS source, sum(weight / (60 + rank + 1)) AS rrf FROM grouped GROUP BY group_key),
scored AS (SELECT *, {_relevance('title', 'abstract_text', 'doi', 'publication_date')} AS rel FROM merged WHERE strlen(regexp_replace(title, '^\s+|\s+$', '', 'g')) > 10 AND (cited_by_count IS NULL OR cited_by_count >= 10))
SELECT id, title, source, round(rel, 6) AS relevance, round(0.4 * rrf + 0.35 * rel + 0.25 * ln(1 + coalesce(cited_by_count, 0)) / ln(10001), 6) AS score FROM scored
ORDER BY 0.4 * rrf + 0.35 * rel + 0.25 * ln(1 + coalesce(cited_by_count, 0)) / ln(10001) DESC, id LIMIT 20""",
)

_SAME = "(greatest(least(k.x2, c.x2) - greatest(k.x1, c.x1), 0.0) * greatest(least(k.y2, c.y2) - greatest(k.y1, c.y1), 0.0))"
_BOTH = f"((k.x2 - k.x1) * (k.y2 - k.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - {_SAME})"

# box by box of a page, in the order of confidence, with the kept ones in a list
SCORING["nms_kept"] = (
    _with("boxes", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    + rf""", ranked AS (SELECT *, CASE WHEN class_name IN ('image', 'table') THEN 2 WHEN class_name = 'display_formula' THEN 3 WHEN class_name = 'header' THEN 5 ELSE 4 END AS p FROM boxes),
o AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY confidence DESC, unique_id, p, x1, y1, x2, y2, class_name) AS r, struct_pack(x1, y1, x2, y2, p, class_name, unique_id) AS c FROM ranked),
w AS (SELECT doc, CAST(0 AS BIGINT) AS r, list_filter([c], lambda x: false) AS kept FROM o WHERE r = 1
  UNION ALL
  SELECT w.doc, o.r, CASE WHEN len(list_filter(kept, lambda k: coalesce({_SAME.replace('c.', 'o.c.')} / nullif({_BOTH.replace('c.', 'o.c.')}, 0), 0) >= 0.95
    OR (coalesce({_SAME.replace('c.', 'o.c.')} / nullif({_BOTH.replace('c.', 'o.c.')}, 0), 0) >= 0.7 AND k.class_name <> o.c.class_name AND o.c.p >= k.p))) > 0 THEN kept ELSE list_append(kept, o.c) END
  FROM w JOIN o ON o.doc = w.doc AND o.r = w.r + 1),
last AS (SELECT doc, arg_max(kept, r) AS kept FROM w GROUP BY doc)
SELECT doc, CAST(k.unique_id AS INTEGER) AS unique_id FROM (SELECT doc, unnest(kept) AS k FROM last)"""
)


def _cell(c: str) -> str:
    plain = lambda t: f"regexp_replace(CAST({t}.{c} AS VARCHAR), '[^A-Za-z0-9]', '', 'g')"
    return f"levenshtein({plain('a')}, {plain('b')}) * 1.0::DOUBLE / greatest(length({plain('a')}), length({plain('b')}), 1)"


# of two tables of the same rows no other edit is cheaper than changing the cells; seven nodes
SCORING["table_scores"] = (
    "SELECT a.l_orderkey, a.l_linenumber, round(max(1 - (" + " + ".join(map(_cell, ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))) + ") / 7) * 100, 6) AS teds "
    "FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2"
)

@query
def latex_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the texts in fractions of fractions, groups and scripts."""
    from scholia.functions.latex import plain_latex

    # the first four words and what stands around them: no more of a text is cleaned, and that once
    head = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^ ]*+(?: [^a-z]*+[a-z][^ ]*+){0,3}", 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.split(F.regexp_replace(head, "[^a-z ]", ""), " +"))).alias("w"))
    word = lambda k: F.coalesce(F.get("w", F.lit(k)), F.lit(""))
    a, b, c = (word(k) for k in (1, 2, 3))
    latex = F.concat(F.lit(r"$\frac{\frac{"), a, F.lit(r"}{\mathbf{"), b, F.lit(r"}}}{\sqrt{"), c, F.lit(r"}} \times \alpha_{"), a, F.lit(r"^{"), b, F.lit(r"}}\,\leq "), F.col("doc_id").cast("string"), F.lit("$"))
    return docs.select("doc_id", plain_latex(latex).alias("plain"))


SCORING["latex_texts"] = r"""WITH w AS (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g'), ' +') AS w FROM documents),
p AS (SELECT doc_id, coalesce(w[2], '') AS a, coalesce(w[3], '') AS b, coalesce(w[4], '') AS c FROM w)
SELECT doc_id, a || '/' || b || '/' || c || ' × α' || a || b || '≤ ' || doc_id AS plain FROM p"""

__all__ = ["QUERIES", "SCORING"]
