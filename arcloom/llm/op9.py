"""Query ``op9_winnowing``."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.llm.decontaminate import contamination
from arcloom.llm.registry import query, table

_WORDS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[a-z0-9\\x{80}-\\x{10FFFF}]+')")

SQL = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT item_id, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM item WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS window FROM windows),
doc AS (SELECT doc_id, coalesce({_WORDS}, []) AS w, row_number() OVER () AS r FROM documents),
places AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM doc, (SELECT DISTINCT size FROM wanted) WHERE len(w) >= size),
found AS (SELECT r, p.size, i, item_id FROM places p JOIN wanted n ON n.size = p.size AND n.window = array_to_string(w[i:i + p.size - 1], ' ')),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS k FROM found) GROUP BY r),
ids AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""


@query("op9_winnowing", SQL)
def op9(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
