"""From a user's request to playlist rows: the seed song in stages, the walk, and rows with names and mood profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.functions.moods import ranked_moods
from arcloom.operators.playlist import arc_positions, generate_playlists, seed_random, validate_requests
from arcloom.operators.search import resolve_seed, resolve_seed_by_id
from arcloom.sources.workspace import store


def resolve_requests(requests: DataFrame, songs: DataFrame, pools: DataFrame, sizes: DataFrame, seed="seed") -> DataFrame:
    """``(request_id, id, stage, resolved)``: the seed song of ``requests (request_id, seed_id, seed_query, arc, wanted)``.

    An id decides; without one a text query that is not blank; with neither a random song of the first mood is drawn. Every stage
    sees its own requests only. An id or a text that is not found leaves the request unresolved, with a null ``id``; it never falls
    to a later stage, since the user asked for something else.
    """
    requests = store(requests.withColumn("stage", F.when(F.col("seed_id").isNotNull(), "id").when(
        F.length(F.trim(F.coalesce("seed_query", F.lit("")))) > 0, "text").otherwise("random")), "staged-requests")

    def stage(name):
        return requests.filter(F.col("stage") == name)

    by_id = resolve_seed_by_id(stage("id"), songs).select("request_id", F.when(F.col("resolved"), F.col("seed_id")).alias("id"))
    asked = stage("text").select(F.col("request_id").alias("query_id"), F.col("seed_query").alias("text"))
    by_text = resolve_seed(asked, songs).select(F.col("query_id").alias("request_id"), "id")
    drawn = seed_random(stage("random"), pools, sizes, songs, seed).select("request_id", "id")
    parts = [found.withColumn("stage", F.lit(name)) for found, name in ((by_id, "id"), (by_text, "text"), (drawn, "random"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("resolved", F.col("id").isNotNull())


def playlist_rows(playlists: DataFrame, songs: DataFrame, profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """``playlists`` with ``name``, ``artist``, ``moods`` (scores by label) and ``top_mood``, the first label on ties."""
    named = labels.select(F.struct("label_id", "label").alias("l")).agg(F.map_from_entries(F.array_sort(F.collect_list("l")))).scalar()
    top = F.try_element_at(ranked_moods(F.col("scores")), F.lit(1))
    best = F.element_at("mood_ids", top["pos"] + 1)
    shown = profiles.withColumn("_names", named).select(
        "id", F.map_from_arrays(F.transform("mood_ids", lambda m: F.element_at("_names", m)), "scores").alias("moods"), F.element_at("_names", best).alias("top_mood"))
    return playlists.join(songs.select("id", "name", "artist"), "id", "left").join(shown, "id", "left")


def serve(requests: DataFrame, songs: DataFrame, profiles: DataFrame, labels: DataFrame, neighbours: DataFrame, pools: DataFrame,
          sizes: DataFrame, profile: str = "service", seed="walk", scorer=None) -> tuple[DataFrame, DataFrame]:
    """Playlists with names for all valid and resolved ``requests``, and every request's outcome.

    ``requests`` are ``request_id, seed_id, seed_query, arc (labels), temperature, playlist_len, wanted``. The outcome is
    ``(request_id, errors, stage, seed, n_songs)``: invalid requests carry their errors, and an unresolved seed is one.
    """
    checked = store(validate_requests(requests, labels), "checked-requests")
    valid = arc_positions(checked.filter(F.size("errors") == 0), labels)
    seeds = store(resolve_requests(valid, songs, pools, sizes), "resolved-seeds")
    known = seeds.filter("resolved")
    walked = store(generate_playlists(valid.join(known.select("request_id"), "request_id", "left_semi"), known.select("request_id", "id"),
                                      neighbours, pools, sizes, profile, seed, scorer), "playlists")
    counts = walked.groupBy("request_id").agg(F.count("*").alias("n_songs"))
    outcome = checked.select("request_id", "errors").join(seeds, "request_id", "left").join(counts, "request_id", "left").select(
        "request_id", F.when(F.col("resolved") == F.lit(False), F.array(F.lit("seed not found"))).otherwise(F.col("errors")).alias("errors"),
        "stage", F.col("id").alias("seed"), F.coalesce("n_songs", F.lit(0)).alias("n_songs"))
    return playlist_rows(walked, songs, profiles, labels), outcome
