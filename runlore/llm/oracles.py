"""DuckDB SQL for the rows of queries whose operators SQL can express, if at the cost of brute force."""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS (SELECT r, doc_id, len(g) AS n FROM s),
e AS (SELECT r, unnest(g) AS g FROM s),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(r, o) AS (SELECT r, r FROM n UNION SELECT reach.r, b FROM reach JOIN both_ways ON reach.o = a)
SELECT n.doc_id, n.n AS n_shingles, min(m.doc_id) AS component_id
FROM n JOIN reach ON reach.r = n.r JOIN n m ON m.r = reach.o GROUP BY n.r, n.doc_id, n.n
"""

REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, p, hash(array_slice(b, p, p + 399)) AS h
      FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d WHERE octet_length(b) >= 400)),
starts AS (SELECT r, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400, true) AS fresh FROM starts),
numbered AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY r ORDER BY p) AS k FROM marked),
spans AS (SELECT r, k, min(p) AS s, max(p) + 399 AS e FROM numbered GROUP BY r, k),
gaps AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s - 1 AS z FROM spans
         UNION ALL SELECT d.r, coalesce(max(e), 0), any_value(octet_length(b)) FROM d LEFT JOIN spans ON spans.r = d.r GROUP BY d.r),
kept AS (SELECT gaps.r, string_agg(substring(hex(b), 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS x FROM gaps JOIN d ON d.r = gaps.r GROUP BY gaps.r),
sums AS (SELECT r, sum(e - s + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
w2 AS (SELECT r, p, hash(array_slice(b, p, p + 255)) AS h
       FROM (SELECT r, b, unnest(range(1, octet_length(b) - 254)) AS p FROM d WHERE octet_length(b) >= 256)),
starts2 AS (SELECT r, p FROM w2 WHERE h IN (SELECT h FROM w2 GROUP BY h HAVING count(*) > 1)),
passages AS (SELECT r, sum(least(256, coalesce(q - p, 256))) AS n_passage_bytes
             FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM starts2) GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256,
       coalesce(n_passage_bytes, 0) AS n_passage_bytes, CAST(n_passage_bytes IS NOT NULL AS INTEGER) AS has_passage
FROM d JOIN kept ON kept.r = d.r LEFT JOIN sums ON sums.r = d.r LEFT JOIN passages ON passages.r = d.r
"""
