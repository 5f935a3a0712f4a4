"""Query ``op12_importance_resampling``; its SQL takes the CRC of each distinct feature byte by byte."""

from __future__ import annotations

from arcloom.llm.importance import resample
from arcloom.llm.registry import query, table

_WORDS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[a-z0-9\\x{80}-\\x{10FFFF}]+')")

SQL = f"""
WITH RECURSIVE steps AS (
  SELECT range AS byte, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS tab FROM steps WHERE k = 8),
doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
item AS (SELECT {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
feature AS MATERIALIZED (
  SELECT r, f, count(*) AS n FROM (
    SELECT r, unnest(w) AS f FROM doc UNION ALL SELECT r, w[i] || ' ' || w[i + 1] FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM doc)) GROUP BY r, f),
aim AS MATERIALIZED (
  SELECT f, count(*) AS n FROM (
    SELECT unnest(w) AS f FROM item UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM item)) GROUP BY f),
bytes AS (SELECT f, list_transform(range(0, strlen(f)), lambda i: ('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2])::BIGINT) AS b
          FROM (SELECT f FROM feature UNION SELECT f FROM aim)),
bucket AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS k FROM bytes, crc),
here AS (SELECT k, sum(n)::BIGINT AS s FROM feature JOIN bucket USING (f) GROUP BY k),
there AS (SELECT k, sum(n)::BIGINT AS t FROM aim JOIN bucket USING (f) GROUP BY k),
whole AS (SELECT (SELECT coalesce(sum(n), 0) FROM feature)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM aim)::DOUBLE AS t_all),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS g
         FROM here LEFT JOIN there USING (k), whole),
mean AS (SELECT r, sum(n)::BIGINT AS n, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM feature JOIN bucket USING (f) JOIN gain USING (k) GROUP BY r),
score AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS words,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM doc LEFT JOIN mean USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM score WHERE words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
       CASE WHEN rank <= 25 * (SELECT count(*) FROM placed) // 100 THEN rank END::BIGINT AS rank FROM score LEFT JOIN placed USING (r)
"""


@query("op12_importance_resampling", SQL)
def op12(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
