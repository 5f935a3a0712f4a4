"""Query ``op3_robust_outliers``."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.llm import quality as Q
from arcloom.llm.registry import query, table
from arcloom.sources.workspace import store

_SPACE = r"[^\x20\x09-\x0D]"


def _sql() -> str:
    moments, lower, inverse = Q.estimate_columns()
    names = ["n", *[f"s{i}" for i in range(Q.P)], *[f"s{i}{j}" for i, j in Q.PAIRS]]
    sums = ", ".join(["count(*) AS n", *[f"sum(x{i}) AS s{i}" for i in range(Q.P)], *[f"sum(x{i} * x{j}) AS s{i}{j}" for i, j in Q.PAIRS]])
    means, inv = ", ".join(f"m{i}" for i in range(Q.P)), ", ".join(f"k{i}{j}" for i, j in Q.PAIRS)
    parts = []

    def estimate(name: str, source: str) -> None:
        """Chained selects, each with one more column, as later ones use the earlier."""
        parts.append(f"{name}_0 AS (SELECT g, start, n, {', '.join(f'{e} AS {c}' for c, e in moments)} FROM {source})")
        for k, (c, e) in enumerate([*lower, *inverse]):
            parts.append(f"{name}_{k + 1} AS (SELECT *, {e} AS {c} FROM {name}_{k})")
        parts.append(f"{name} AS MATERIALIZED (SELECT g, start, {means}, {inv}, {Q.DETERMINANT} AS det FROM {name}_{len(lower) + len(inverse)})")

    spread = [f"sqrt((1.4826 * a{i}) * (1.4826 * a{i}) + {(s * Q.SCALE) ** 2!r})" for i, s in enumerate(Q.LEAST_SPREAD)]
    medians = ", ".join(f"median(x{i}) AS m{i}" for i in range(Q.P))
    spreads = ", ".join(f"median(abs(x{i} - m{i})) AS a{i}" for i in range(Q.P))
    diagonal = ", ".join(f"1.0 / {spread[i]} AS k{i}{j}" if i == j else f"0.0::DOUBLE AS k{i}{j}" for i, j in Q.PAIRS)
    parts.append(f"all_sums AS (SELECT g, 'all' AS start, {sums} FROM vec GROUP BY g)")
    estimate("all_start", "all_sums")
    parts.append(f"med AS MATERIALIZED (SELECT g, {medians} FROM vec GROUP BY g)")
    parts.append(f"mad AS MATERIALIZED (SELECT g, {spreads} FROM vec JOIN med USING (g) GROUP BY g)")
    parts.append(f"e0 AS MATERIALIZED (SELECT g, 'median' AS start, {means}, {diagonal}, 0.0 AS det FROM med JOIN mad USING (g) "
                 f"UNION ALL SELECT g, start, {means}, {inv}, det FROM all_start)")
    for k in range(Q.STEPS):
        parts.append(f"bin{k} AS MATERIALIZED (SELECT g, start, floor({Q.BINS} * ln(d2 + 1e-6)) AS bin, {sums} "
                     f"FROM (SELECT *, {Q.DISTANCE} AS d2 FROM vec JOIN e{k} USING (g)) GROUP BY ALL)")
        parts.append(f"cum{k} AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, "
                     f"sum(n) OVER (PARTITION BY g, start) AS total FROM bin{k})")
        parts.append(f"in{k} AS (SELECT g, start, {', '.join(f'sum({c}) AS {c}' for c in names)} FROM cum{k} "
                     f"WHERE before < ceil({Q.COVERAGE}::DOUBLE * total) GROUP BY g, start)")
        estimate(f"e{k + 1}", f"in{k}")
    vector = ", ".join(f"round(({s}) * {Q.SCALE})::BIGINT AS {x}" for x, s in zip(Q.X, Q.STATISTICS))
    return f"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {{'l': lang, 's': source}} AS g, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_SPACE}+') AS w FROM documents),
tri AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS h FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2)),
rep AS (
  SELECT r, count(DISTINCT k) AS n_repeat_words FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM tri) WHERE c > 1) GROUP BY r),
base AS MATERIALIZED (
  SELECT r, doc_id, g, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')))))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM doc LEFT JOIN rep USING (r)),
judged AS MATERIALIZED (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
vec AS MATERIALIZED (SELECT r, g, {vector} FROM judged WHERE NOT base_failed),
{", ".join(parts)},
best AS MATERIALIZED (SELECT * FROM e{Q.STEPS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, start) = 1),
verdict AS (SELECT r, {Q.DISTANCE} <= {Q.CUTOFF} AS kept FROM vec JOIN best USING (g))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(kept, false) AS kept
FROM judged LEFT JOIN verdict USING (r)
"""


@query("op3_robust_outliers", _sql())
def op3(spark, sf_dir):
    rows = Q.base_statistics(table(spark, sf_dir, "documents").select("doc_id", "text", *Q.GROUP)).drop("text")
    return Q.judge(store(rows, "base-statistics")).select("doc_id", *Q.BASE, "kept")
