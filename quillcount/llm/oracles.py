"""SQL of the operators' queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS v, a AS r FROM edges UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.v
), part AS (
  SELECT v, MIN(r) AS p FROM reach GROUP BY v
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(p, d.doc_id) AS component_id, coalesce(p, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN part ON v = d.doc_id
"""

SUFFIX_DEDUP = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w) WHERE k > 1
), runs AS (
  SELECT doc_id, MIN(i) AS a, MAX(i) + 100 AS b FROM (SELECT doc_id, i, SUM(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= LAG(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM late)) GROUP BY doc_id, run
), kept AS (
  SELECT d.doc_id, string_agg(substr(x, CAST(2 * f + 1 AS BIGINT), CAST(2 * (t - f) AS BIGINT)), '' ORDER BY f) AS x FROM (
    SELECT doc_id, a, coalesce(LAG(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM runs
    UNION ALL SELECT r.doc_id, NULL, MAX(b), ANY_VALUE(n) FROM runs r JOIN d ON d.doc_id = r.doc_id GROUP BY r.doc_id
  ) g JOIN d ON d.doc_id = g.doc_id GROUP BY d.doc_id
), sums AS (
  SELECT doc_id, CAST(SUM(b - a) AS BIGINT) AS n_removed, COUNT(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

ORACLES = {"op1_minhash_near_dedup": NEAR_DEDUP, "op9_suffix_dedup": SUFFIX_DEDUP}
