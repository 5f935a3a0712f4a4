"""Keyed table maintenance on immutable files: each result is a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.sources.workspace import new_path


def _first_per_key(df: DataFrame, key: str, order) -> DataFrame:
    return (
        df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        .filter("_rn = 1").drop("_rn")
    )


def new_rows(existing: DataFrame, incoming: DataFrame, key: str, order) -> DataFrame:
    """Incoming rows with an unknown key, the first of each."""
    return _first_per_key(incoming.join(existing.select(key), key, "left_anti"), key, order)


def append_new_rows(existing: DataFrame, incoming: DataFrame, key: str, order) -> DataFrame:
    """Existing rows win over incoming ones. ``inserted`` tells the new rows apart."""
    fresh = new_rows(existing, incoming, key, order).withColumn("inserted", F.lit(True))
    return existing.withColumn("inserted", F.lit(False)).unionByName(fresh, allowMissingColumns=True)


def upsert_features(existing: DataFrame, incoming: DataFrame, key: str, stamp: Column, order) -> DataFrame:
    """Incoming rows replace existing ones; the last of each key wins and is stamped. One shuffle by key."""
    stamped = incoming.withColumns({"processed_at": stamp, "_new": F.lit(1)})
    both = existing.withColumn("_new", F.lit(0)).unionByName(stamped, allowMissingColumns=True)
    return _first_per_key(both, key, [F.desc("_new"), *order]).drop("_new")


def overwrite_table(df: DataFrame, name: str, partition_by=()) -> DataFrame:
    """Write to a path that has never been used and read it back; a rerun never sees half a table."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def update_metadata(metadata: DataFrame, updates: DataFrame, key: str, order=()) -> DataFrame:
    """Merge by key: a non-null new value wins, new fields are added.

    Of several updates for a key the first in ``order`` counts; without an order, the largest by its fields.
    """
    fields = [c for c in updates.columns if c != key]
    updates = _first_per_key(updates, key, list(order) or [F.desc(c) for c in fields] or [key])
    renamed = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    merged = metadata.join(renamed, key, "left")
    kept = [c for c in metadata.columns if c not in fields]
    return merged.select(*kept, *[
        F.coalesce(f"_new_{c}", c).alias(c) if c in metadata.columns else F.col(f"_new_{c}").alias(c)
        for c in fields])


def export_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, edges array<struct<target, score>>)`` best first; nodes without edges keep an empty list."""
    entry = F.struct((-F.col("score")).alias("neg"), F.col("dst").alias("target"), "score")
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("edges"))
    plain = F.transform("edges", lambda e: F.struct(e["target"].alias("target"), e["score"].alias("score")))
    empty = F.array().cast(lists.select(plain.alias("e")).schema["e"].dataType)
    return nodes.select("id").join(lists, "id", "left").select("id", F.coalesce(plain, empty).alias("edges"))


def import_adjacency(adjacency: DataFrame) -> DataFrame:
    """The inverse of :func:`export_adjacency`."""
    return adjacency.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select(
        "src", F.col("e.target").alias("dst"), F.col("e.score").alias("score"))


def write_playlists(playlists: DataFrame, buckets: int = 64) -> DataFrame:
    """Store playlists and read them back.

    Partitioned by a bounded bucket of the request id: one folder per request would mean one file each.
    Rebalancing lets Spark merge small buckets and split big ones into files of even size.
    """
    bucketed = playlists.withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int"))
    return overwrite_table(bucketed.hint("rebalance", "bucket"), "playlists", ["bucket"]).drop("bucket")


def playlist_json(playlists: DataFrame) -> DataFrame:
    """One JSON document per request, songs in playing order; a playlist has at most 51 songs."""
    row = F.struct("pos", *[c for c in playlists.columns if c not in ("request_id", "pos")])
    return playlists.groupBy("request_id").agg(
        F.to_json(F.array_sort(F.collect_list(row))).alias("playlist"))
