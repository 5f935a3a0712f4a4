"""Balanced positive and negative song pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.hashing import uniform
from arcloom.operators.catalogue import random_order
from arcloom.operators.neighbours import nearest
from arcloom.operators.positions import hash_positions
from arcloom.sources.workspace import store

NEAREST = 3


def _draws(songs: DataFrame, rows: int, n_songs, seed, names) -> DataFrame:
    """``rows`` draw numbers, each with uniform song positions in the named columns."""
    ids = songs.sparkSession.range(rows).withColumnRenamed("id", "draw")
    return ids.select("draw", *[
        F.least(F.floor(uniform(f"{seed}-{n}", "draw") * n_songs), n_songs - 1).alias(n) for n in names])


def positive_pairs(songs: DataFrame, knn: DataFrame | None, n: int, seed="positive") -> DataFrame:
    """``n`` pairs ``(draw, a, b)``: songs drawn with replacement, each with one of its 3 nearest.

    Without ``knn`` the neighbours are searched for the drawn songs only.
    """
    numbered = hash_positions(songs.select("id"), f"{seed}-order", ["id"])
    total = songs.agg(F.count("*")).scalar()
    drawn = _draws(songs, n, total, seed, ["pos"]).join(numbered.select("pos", F.col("id").alias("a")), "pos").select("draw", "a")
    if knn is None:
        drawn = store(drawn, "drawn-songs")
        knn = nearest(songs, NEAREST, queries=drawn.select(F.col("a").alias("id")))
    near = knn.filter(F.col("rank") <= NEAREST)
    options = near.groupBy(F.col("src").alias("a")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("near"))
    pick = F.floor(uniform(f"{seed}-pick", "draw") * F.size("near")) + 1
    return drawn.join(options, "a").select("draw", "a", F.element_at("near", pick.cast("int"))["dst"].alias("b"))


def negative_pairs(assigned: DataFrame, n: int, seed="negative", label="label_id") -> DataFrame:
    """``n`` pairs ``(draw, a, b)`` of songs in different clusters; none if there is one cluster only.

    Songs are numbered cluster by cluster. ``b`` is drawn from the numbers outside the cluster of ``a``, so every draw is a hit.
    """
    songs = assigned.select("id", F.col(label).alias("l"))
    numbered = hash_positions(songs, f"{seed}-order", ["id"], groups=["l"], out="at")
    before = Window.orderBy("l").rowsBetween(Window.unboundedPreceding, -1)
    clusters = songs.groupBy("l").agg(F.count("*").alias("size")).withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
    clusters = clusters.select(F.col("l").alias("_l"), "size", "first")
    placed = numbered.join(clusters, F.col("l").eqNullSafe(F.col("_l"))).select("id", "size", "first", (F.col("first") + F.col("at")).alias("pos"))
    total = assigned.agg(F.count("*")).scalar()
    draws = assigned.sparkSession.range(n).select(F.col("id").alias("draw"), F.least(
        F.floor(uniform(f"{seed}-a", "id") * total), total - 1).alias("pos"))
    first = draws.join(placed, "pos").filter(F.col("size") < total).select("draw", F.col("id").alias("a"), "size", "first")
    room = total - F.col("size")
    other = F.least(F.floor(uniform(f"{seed}-b", "draw") * room), room - 1)
    second = first.withColumn("pos", F.when(other < F.col("first"), other).otherwise(other + F.col("size")))
    return second.join(placed.select("pos", F.col("id").alias("b")), "pos").select("draw", "a", "b")


def balance_shuffle(positives: DataFrame, negatives: DataFrame, seed="shuffle") -> DataFrame:
    """Both kinds with ``label`` 1 and 0, numbered in random order."""
    both = positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)))
    return random_order(both, seed, ["label", "draw"])


def pair_stats(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"), F.max(F.size("features")).alias("dim"))
