"""Exact global positions and running totals without sorting everything in one task.

Rows are cut into buckets that are ordered like the rows themselves. Bucket sizes are a small
aggregate; a running sum over them gives each bucket its offset, and only the order inside a
bucket needs a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.hashing import hash_bucket, hash_hex


def with_positions(df: DataFrame, *, bucket: Column, order, groups=(), out: str = "pos",
                   quota: Column | None = None) -> DataFrame:
    """Add the 0-based position ``out`` and the group size ``out_n``.

    ``bucket`` must grow with ``order`` inside each group. ``quota`` may use ``out_n``; rows at or
    beyond it are dropped, whole buckets of them before the shuffle.
    """
    groups = list(groups)
    keyed = df.withColumn("_bucket", bucket)
    by_group = Window.partitionBy(*(groups or [F.lit(0)]))
    offsets = (
        keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_rows"))
        .withColumn("_start", F.coalesce(
            F.sum("_rows").over(by_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)))
        .withColumn(f"{out}_n", F.sum("_rows").over(by_group))
    )
    if quota is not None:
        offsets = offsets.filter(F.col("_start") < quota)
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    ranked = (
        keyed.join(offsets, groups + ["_bucket"])
        .withColumn(out, F.col("_start") + F.row_number().over(inside) - 1)
    )
    if quota is not None:
        ranked = ranked.filter(F.col(out) < quota)
    return ranked.drop("_bucket", "_rows", "_start")


def hash_positions(df: DataFrame, seed, keys, *, groups=(), out: str = "pos",
                   quota: Column | None = None) -> DataFrame:
    """Positions in a seeded random order of the rows; ``keys`` must identify a row."""
    hashed = df.withColumn("_hex", hash_hex(seed, *keys))
    return with_positions(
        hashed, bucket=hash_bucket(F.col("_hex")), order=["_hex", *keys], groups=groups, out=out, quota=quota,
    ).drop("_hex")


def running_total(df: DataFrame, order_col: str, value_cols, *, slices: int = 256) -> DataFrame:
    """Sum of each value over all rows with a smaller ``order_col``, as ``<value>_before``.

    ``order_col`` must be unique and not null, and ``df`` a stored table: it is read three times. Quantile cut points keep the slices even whatever the values are.
    """
    cuts = df.agg(
        F.percentile_approx(order_col, [i / slices for i in range(1, slices)], 10 * slices)
    ).scalar()
    sliced = df.withColumn("_cuts", cuts).withColumn(
        "_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(order_col))), F.lit(0))).drop("_cuts")
    whole = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sliced.groupBy("_slice").agg(*[F.sum(v).alias(f"_{v}") for v in value_cols]).select(
        "_slice", *[F.coalesce(F.sum(f"_{v}").over(whole), F.lit(0)).alias(f"_{v}") for v in value_cols])
    inside = Window.partitionBy("_slice").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return sliced.join(before, "_slice").select(
        *df.columns,
        *[(F.col(f"_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before") for v in value_cols],
    )
