"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"list_distinct([x for x in string_split(translate(lower(line), chr(9)||chr(13)||chr(12)||chr(11), '    '), ' ') if x <> ''])"

# Lines whose word sets reach Jaccard 0.8 with an earlier line go. The pairs are
# found by words that rank among the rarest fifth of both lines.
LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT doc_id, pos, line, {_WORDS} AS w FROM lines),
firsts AS (
  SELECT line, any_value(w) AS w, arg_min(doc_id, row(doc_id, pos)) AS d, arg_min(pos, row(doc_id, pos)) AS p
  FROM worded WHERE len(w) > 0 GROUP BY line),
each_word AS (SELECT d, p, len(w) AS n, unnest(w) AS word FROM firsts),
counted AS (SELECT word, count(*) AS c FROM each_word GROUP BY word),
ranked AS (
  SELECT d, p, n, word, row_number() OVER (PARTITION BY d, p ORDER BY c, word) AS r
  FROM each_word JOIN counted USING (word)),
prefix AS (SELECT * FROM ranked WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (
  SELECT DISTINCT x.d, x.p, y.d AS d2, y.p AS p2 FROM prefix x JOIN prefix y
  ON x.word = y.word AND (y.d < x.d OR (y.d = x.d AND y.p < x.p)) AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9),
alike AS (
  SELECT DISTINCT q.d, q.p FROM pairs q JOIN firsts a ON a.d = q.d AND a.p = q.p JOIN firsts b ON b.d = q.d2 AND b.p = q.p2
  WHERE len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9),
gone AS (
  SELECT w.doc_id, w.pos FROM worded w JOIN firsts f ON f.line = w.line LEFT JOIN alike s ON s.d = f.d AND s.p = f.p
  WHERE s.d IS NOT NULL OR w.doc_id <> f.d OR w.pos <> f.p),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(c.c, 0) AS n_lines_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN counts c ON c.doc_id = d.doc_id
"""

_FOLDED = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
items AS (SELECT DISTINCT item_id, {_FOLDED} AS w FROM benchmark WHERE text IS NOT NULL),
patterns AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS pattern
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM patterns),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
runs AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS run
  FROM places, sizes WHERE i + k - 1 <= len(w)),
found AS (SELECT r.doc_id, r.i, r.k, p.item_id FROM runs r JOIN patterns p ON p.k = r.k AND p.pattern = r.run),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), 'null') AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

SQL = {"op7_line_dedup": LINE_DEDUP, "op9_benchmark_decontamination": DECONTAMINATION}
