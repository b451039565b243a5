"""DuckDB SQL of corpus queries, plain: every window, every pair. The method of the operator plays no part in it."""

from __future__ import annotations

#: Removal of repeated 50-word windows.
SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
s AS (SELECT k.doc_id, k.i FROM k JOIN f USING (h) WHERE f.first < k.doc_id),
c AS (SELECT u.doc_id, u.word, u.i, max(s.i) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM u LEFT JOIN s ON s.doc_id = u.doc_id AND s.i = u.i),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""
#: All pairs of 5-gram sets that share a gram, and their components.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS name FROM g GROUP BY doc_id),
c AS (SELECT name, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM s GROUP BY name),
m AS MATERIALIZED (SELECT c.rep, c.n, c.copies, g.g FROM c JOIN g ON g.doc_id = c.rep),
h AS (SELECT g FROM m GROUP BY g HAVING count(*) > 1),
r AS (SELECT m.* FROM m SEMI JOIN h USING (g)),
j AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b, any_value(b.copies) AS copies FROM r a JOIN r b ON a.g = b.g AND a.rep <> b.rep AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n
  GROUP BY a.rep, b.rep HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
reach AS (SELECT rep AS node, rep AS other FROM c UNION SELECT reach.node, j.b FROM reach JOIN j ON reach.other = j.a),
k AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
l AS (SELECT a, count(*) AS n_links, sum(copies) AS docs FROM j GROUP BY a)
SELECT d.doc_id, coalesce(c.rep, d.doc_id) AS rep_id, coalesce(k.class_id, d.doc_id) AS class_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links,
  CAST(coalesce(l.docs, 0) + coalesce(c.copies - 1, 0) AS BIGINT) AS n_linked_docs, CAST(coalesce(s.n, 0) AS BIGINT) AS n_grams
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (name) LEFT JOIN k ON k.node = c.rep LEFT JOIN l ON l.a = c.rep"""
#: All pairs of distinct lines whose lengths allow a link.
LINES_SQL = r"""
WITH l AS (SELECT doc_id, line_no - 1 AS line_no, trim(x, E' \t\n\r\x0b\x0c') AS line FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS line_no FROM (SELECT doc_id, string_split(text, E'\n') AS p FROM documents)) WHERE trim(x, E' \t\n\r\x0b\x0c') <> ''),
c AS (SELECT line, length(line) AS n, min((doc_id, line_no)) AS first, count(*) AS copies FROM l GROUP BY line),
p AS (SELECT a.line AS x, b.line AS y, a.first AS fx, b.first AS fy, least(greatest(a.n, b.n) // 10, 2) AS most FROM c a JOIN c b ON b.n BETWEEN a.n AND a.n + 2 AND (b.n > a.n OR b.line > a.line) AND b.n >= 10),
e AS MATERIALIZED (SELECT x, y, fx, fy FROM p WHERE levenshtein(x, y) <= most),
v AS (SELECT x AS line, fy AS near FROM e UNION ALL SELECT y, fx FROM e),
n AS (SELECT line, count(*) AS n_links, min(near) AS near FROM v GROUP BY line)
SELECT l.doc_id, l.line_no, c.first[1] AS first_doc_id, c.first[2] AS first_line_no, c.copies, coalesce(n.n_links, 0) AS n_links, n.near[1] AS near_doc_id, n.near[2] AS near_line_no,
  (l.doc_id, l.line_no) = c.first AND coalesce(n.near > c.first, true) AS kept
FROM l JOIN c USING (line) LEFT JOIN n USING (line)"""
