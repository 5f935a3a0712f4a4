"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.sources.workspace import store

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``edges (a, b)``: the smallest id that can be reached.

    A *large star* links all larger neighbours of an id to its smallest neighbour, a *small star* all smaller ones;
    the two alternate until nothing changes, after about log2 of the longest chain rounds. Neighbours of an id
    are never gathered: a round is a grouped minimum, combined before the shuffle, and a join with it, which
    Spark can split where one id has very many neighbours. Self-links and null ids are ignored.
    """
    links = store(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    state = _state(links)
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store(large.filter("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        links = store(small.filter("a <> b").distinct(), "small-star")
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    return ids.join(links.groupBy("a").agg(F.min("b").alias("component")), ids["id"] == F.col("a"), "left").select(
        "id", F.coalesce("component", "id").alias("component"))
