"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from scholia.llm.quality_rules import CASED

_WORD = r"'[^\x20\x09-\x0D]+'"
_STOP = ", ".join(f"'{w}'" for w in CASED)

QUALITY_RULES = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM places),
again AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN again USING (doc_id, g), range(0, 5) r(k)),
rep AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines,
    coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.1 AND (n_stop_words + 2) / n_words >= 0.06
    AND n_dup_lines / greatest(n_lines, 1) <= 0.4 AND n_lines / n_words <= 0.5 AS kept,
  n_lines, n_stop_words
FROM b
"""

NEAR_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
sh AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])
    ELSE [array_to_string(w, ' ')] END)) AS s FROM w WHERE len(w) > 0),
reps AS (SELECT s, min(doc_id) AS id, count(*) AS copies, len(s) AS n FROM sh GROUP BY s),
tok AS (SELECT id, unnest(s) AS g FROM reps),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM tok a JOIN tok b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
links AS (SELECT common.a, common.b, y.copies FROM common JOIN reps x ON x.id = common.a JOIN reps y ON y.id = common.b WHERE 1800 * c >= 800 * (x.n + y.n)),
reach(id, root) AS (SELECT id, id FROM reps UNION SELECT links.a, reach.root FROM links JOIN reach ON reach.id = links.b),
root AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
deg AS (SELECT a AS id, count(*) AS n_links, sum(copies) AS n_linked_docs FROM links GROUP BY a),
classes AS (SELECT s, root, copies, coalesce(n_links, 0) AS n_links, CAST(coalesce(n_linked_docs, 0) AS BIGINT) AS n_linked_docs FROM reps JOIN root USING (id) LEFT JOIN deg USING (id))
SELECT d.doc_id, coalesce(root, d.doc_id) AS class_id, coalesce(copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links, coalesce(n_linked_docs, 0) AS n_linked_docs
FROM documents d LEFT JOIN sh USING (doc_id) LEFT JOIN classes USING (s)
"""

_HOST = "translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN contains({0}, '://') THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"
_NODE = (
    _HOST + " || CASE WHEN regexp_extract({0}, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^[^/?#]*([^?#]*)', 1) END"
    " || regexp_extract({0}, '^[^?#]*(\\?[^#]*)', 1)"
)

#: Links are those with an absolute address in a canonical link whose rel comes before its href.
URL_FILTER = rf"""
WITH RECURSIVE rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
r AS (SELECT *, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM rules),
p AS (SELECT page_id, html, {_REST.format("coalesce(url, '')")} AS rest, contains(coalesce(url, ''), '://') AS named FROM pages),
u AS (SELECT page_id, html, {_HOST.format("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, CASE WHEN named THEN {_NODE.format("rest")} END AS node FROM p),
targets AS (SELECT node AS a, unnest(regexp_extract_all(html, '(?i)<link\s+rel="canonical"\s+href="https?://([^"]*)"', 1)) AS t FROM u WHERE node IS NOT NULL),
links AS (SELECT DISTINCT a, b FROM (SELECT a, {_NODE.format("t")} AS b FROM targets) WHERE a <> b),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
ends AS (SELECT DISTINCT a AS node, regexp_extract(a, '^[^/]*') AS host, regexp_extract(a, '^[^/]*([^?]*)', 1) AS path FROM ways),
judged AS (SELECT node, (SELECT max_by(verdict, length(rule)) FROM r WHERE (ends.host = rh OR ends.host LIKE '%.' || rh) AND starts_with(ends.path, rp)) AS verdict FROM ends),
bad AS (SELECT DISTINCT reach.a AS node FROM reach JOIN judged ON judged.node = reach.b AND judged.verdict = 'block'),
held AS (SELECT page_id, host, path, node,
  (SELECT max_by(rule, length(rule)) FROM r WHERE (u.host = rh OR u.host LIKE '%.' || rh) AND starts_with(u.path, rp)) AS rule,
  (SELECT max_by(verdict, length(rule)) FROM r WHERE (u.host = rh OR u.host LIKE '%.' || rh) AND starts_with(u.path, rp)) AS verdict FROM u)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, rule IS NULL AND bad.node IS NOT NULL AS passed_on
FROM held LEFT JOIN bad USING (node)
"""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

LEXICAL_SEARCH = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("text")}, {_TERMS}) AS t FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
norm AS (SELECT doc_id, r, t, 25 + (75 * len(t) * docs) // terms AS m FROM d, s WHERE len(t) > 0),
tf AS (SELECT doc_id, r, m, t, count(*) AS tf FROM (SELECT doc_id, r, m, unnest(t) AS t FROM norm) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, {_TERMS})) AS t FROM benchmark) GROUP BY ALL),
score AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN tf USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 10
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(t) AS t FROM d) GROUP BY ALL),
kept AS (SELECT lang, t, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang, t HAVING count(*) >= 3),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, t, CAST(sum(c.n) AS BIGINT) AS n FROM c JOIN kept USING (lang, t) GROUP BY ALL),
gt AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM g LEFT JOIN own USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, t, coalesce(own.n, 0) AS n, 1 + (1000000000 * (coalesce(own.n, 0) + 1)) // (gt.total + v) AS p,
  1 + (1000000000 * (kept.n + 1)) // (total.total + v) AS q
  FROM gt JOIN total USING (lang) JOIN kept USING (lang) LEFT JOIN own USING (lang, source, t)),
terms AS (SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
