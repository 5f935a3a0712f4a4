"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Each text has base statistics and fails at once if it is too short or too repetitive. The statistics of the others,
transformed to whole numbers (``SCALE`` steps per unit), form a vector. Per language and source a minimum covariance
determinant estimate is made: the ``COVERAGE`` share of rows whose covariance has the least determinant, found by
concentration steps from two starts (coordinate medians, and all rows) that run side by side; the lower determinant
wins. Rows beyond ``CUTOFF`` by squared Mahalanobis distance to that estimate are rejected.

A step is one grouped aggregate over all rows: distances are binned on a logarithmic scale and each bin keeps its
count, sums and sums of products, so the subset is read off a few thousand bins per group instead of sorted rows. All
sums are of whole numbers and therefore the same for every partitioning. ``LEAST_SPREAD`` is added to each standard
deviation: statistics that do not vary in the subset, like symbols in prose, keep a usable unit.

Cases: null and empty texts have no words and fail. Null languages or sources form groups of their own. In a group of
few rows the subset is nearly the whole group, so little is rejected. Equal rows get equal verdicts. An empty table
gives an empty result. Columns of the input with the names of the results are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.sources.workspace import store

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COVERAGE = 0.6
STEPS = 4
CUTOFF = 45.0
SCALE = 1000
BINS = 64
#: Statistics as SQL over the base columns, and the least spread of each.
STATISTICS = {
    "ln(n_words)": 0.5,
    "ln(word_chars / n_words)": 0.06,
    "ln(1 + 100.0 * n_symbols / word_chars)": 0.2,
    "1.0 * n_repeat_words / n_words": 0.1,
    "ln(1.0 + n_dup_lines)": 0.7,
}
LEAST_SPREAD = list(STATISTICS.values())
P = len(STATISTICS)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that stand in the text at least twice."""

    def covered(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def width(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(p, k - 1), F.lit(-3))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(_let(by_hash, places), width))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(_let(words, windows), covered))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the base statistics and ``base_failed``."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.drop(*BASE)
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "*", words.alias("_words"), _let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    counted = counted.select(
        *[c for c in counted.columns if c != "_words"], F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _vector(rows: DataFrame) -> DataFrame:
    """Statistics as whole numbers; null for rows without words."""
    return rows.withColumns({x: F.when(F.col("n_words") > 0, F.round(F.expr(s) * SCALE)).cast("long") for x, s in zip(X, STATISTICS)})


def chi_square_share(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom <= x), by its series."""
    a, x = df / 2, x / 2
    term = total = 1 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def consistency(coverage: float, p: int) -> float:
    """Factor that makes the covariance of the inner ``coverage`` of a normal sample that of all of it."""
    lo, hi = 1e-9, 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_share(mid, p) < coverage else (lo, mid)
    return coverage / chi_square_share(lo, p + 2)


GROUP = ["lang", "source"]
KEYS = [*GROUP, "start"]


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` for the same group, nulls included."""
    named = right.withColumnsRenamed({g: f"_{g}" for g in GROUP})
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in GROUP))
    return left.join(named, same, how).drop(*[f"_{g}" for g in GROUP])


def estimate_columns() -> tuple[list[tuple[str, str]], list[tuple[str, str]], list[tuple[str, str]]]:
    """Means and covariances from sums, the Cholesky factor ``l`` in order of dependence, and its inverse ``k``."""
    factor = consistency(COVERAGE, P)
    moments = [(f"m{i}", f"CAST(s{i} AS DOUBLE) / n") for i in range(P)]
    moments += [(f"c{i}{j}", f"(CAST(s{i}{j} AS DOUBLE) / n - (CAST(s{i} AS DOUBLE) / n) * (CAST(s{j} AS DOUBLE) / n)) * {factor!r}"
                 + (f" + {(LEAST_SPREAD[i] * SCALE) ** 2!r}" if i == j else "")) for i, j in PAIRS]
    lower = []
    for j in range(P):
        inner = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        lower.append((f"l{j}{j}", f"sqrt(c{j}{j}{inner})"))
        for i in range(j + 1, P):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            lower.append((f"l{i}{j}", f"(c{i}{j}{inner}) / l{j}{j}"))
    inverse = []
    for j in range(P):
        inverse.append((f"k{j}{j}", f"1.0 / l{j}{j}"))
        for i in range(j + 1, P):
            inner = " + ".join(f"l{i}{k} * k{k}{j}" for k in range(j, i))
            inverse.append((f"k{i}{j}", f"-({inner}) / l{i}{i}"))
    return moments, lower, inverse


DISTANCE = " + ".join(
    "({0}) * ({0})".format(" + ".join(f"k{i}{j} * (x{j} - m{j})" for j in range(i + 1))) for i in range(P))
#: Sums of logarithms instead of the determinant itself: it has the same order.
DETERMINANT = " + ".join(f"ln(l{i}{i})" for i in range(P))


def _estimates(sums: DataFrame) -> DataFrame:
    moments, lower, inverse = estimate_columns()
    out = sums.select(*KEYS, "n", *[F.expr(e).alias(c) for c, e in moments])
    for name, e in [*lower, *inverse]:
        out = out.withColumn(name, F.expr(e))
    return store(out.select(*KEYS, *[f"m{i}" for i in range(P)], *[f"k{i}{j}" for i, j in PAIRS], F.expr(DETERMINANT).alias("det")), "estimates")


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sums and sums of products, as exact decimals."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.sum(x).cast("decimal(38,0)").alias(f"s{i}") for i, x in enumerate(X)],
        *[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(24,0)")).cast("decimal(38,0)").alias(f"s{i}{j}") for i, j in PAIRS])


def _step(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates from the nearest ``COVERAGE`` of each group under the given ones."""
    joined = _joined(rows, F.broadcast(estimates) if _is_small(estimates) else estimates)
    distances = joined.select(*KEYS, *X, F.expr(DISTANCE).alias("d2"))
    bins = _sums(distances.withColumn("bin", F.floor(BINS * F.ln(F.col("d2") + 1e-6)).cast("int")), [*KEYS, "bin"])
    within = Window.partitionBy(*KEYS)
    before = F.sum("n").over(within.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    inner = bins.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("n").over(within)}).filter(
        F.col("before") < F.ceil(F.lit(COVERAGE) * F.col("total")))
    names = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in PAIRS]]
    return _estimates(inner.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in names]))


SMALL_GROUPS = 10_000


def _is_small(estimates: DataFrame) -> bool:
    """Is it few enough groups to send to every task? Otherwise Spark joins them its own way."""
    return estimates.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS


def _median_start(rows: DataFrame) -> DataFrame:
    """Median and median deviation per statistic; whole numbers of a bounded range, so few distinct values."""
    medians = rows.groupBy(*GROUP).agg(*[F.percentile(x, F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(X)])
    joined = _joined(rows, medians).select(
        *GROUP, *[F.abs(F.col(x) - F.col(f"m{i}")).alias(f"a{i}") for i, x in enumerate(X)])
    spreads = joined.groupBy(*GROUP).agg(*[F.percentile(f"a{i}", F.lit(0.5)).alias(f"a{i}") for i in range(P)])
    both = _joined(medians, spreads)
    spread = [f"sqrt((1.4826 * a{i}) * (1.4826 * a{i}) + {(LEAST_SPREAD[i] * SCALE) ** 2!r})" for i in range(P)]
    return both.select(*GROUP, F.lit("median").alias("start"), *[f"m{i}" for i in range(P)],
                       *[(F.lit(1.0) / F.expr(spread[i]) if i == j else F.lit(0.0)).alias(f"k{i}{j}") for i, j in PAIRS], F.lit(0.0).alias("det"))


def _all_start(rows: DataFrame) -> DataFrame:
    return _estimates(_sums(rows.withColumn("start", F.lit("all")), KEYS))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Location and inverse factor of each group, from ``rows`` with the vector columns."""
    now = store(_median_start(rows).unionByName(_all_start(rows)), "starts")
    for _ in range(STEPS):
        now = _step(rows, now)
    best = Window.partitionBy(*GROUP).orderBy("det", "start")
    return store(now.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank", "start"), "robust-estimates")


def judge(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`base_statistics` with ``distance`` (null if the base rules failed) and ``kept``.

    ``rows`` is read several times: give it stored.
    """
    passed = _vector(rows.filter(~F.col("base_failed")).select(*GROUP, *BASE[:-1])).select(*GROUP, *X)
    estimates = robust_estimates(passed)
    side = F.broadcast(estimates) if _is_small(estimates) else estimates
    joined = _joined(rows, side, "left")
    distance = F.when(~F.col("base_failed"), F.expr(DISTANCE))
    return _vector(joined).select(*[c for c in rows.columns], distance.alias("distance"), F.coalesce(distance <= CUTOFF, F.lit(False)).alias("kept"))

