"""Query ``op1_ngram_jaccard_join``."""

from __future__ import annotations

from arcloom.llm.ngram_join import ngram_components
from arcloom.llm.registry import query, table

SQL = """
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
gram AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM gram x JOIN gram y USING (g) JOIN size s ON s.doc_id = x.doc_id JOIN size t ON t.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, s.n, t.n HAVING 100 * count(*) >= 85 * (s.n + t.n - count(*))),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
       least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM doc d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""


@query("op1_ngram_jaccard_join", SQL)
def op1(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
