"""The mood index and the pools drawn from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.functions.moods import dominant_flag, ranked_moods
from arcloom.operators.positions import hash_positions

# The admission rules of the mood index and of candidates.
INDEX_FLOOR, SECOND_FLOOR, SECOND_RATIO = 0.30, 0.40, 0.85
LOOSE_FLOOR = 0.15
THIN_POOL = 100


def mood_index(profiles: DataFrame) -> DataFrame:
    """``(id, mood, rank, score)`` for songs strong in a mood; ``mood`` is a position in label order.

    Decided inside each row, so the index costs one scan.
    """
    ranked = F.transform(ranked_moods(F.col("scores")), lambda m, r: F.struct(
        r.alias("rank"), m["pos"].alias("mood"), m["score"].alias("score")))
    best = F.element_at(ranked, 1)["score"]
    kept = F.filter(F.slice(ranked, 1, 2), lambda m: ((m["rank"] == 0) & (m["score"] >= INDEX_FLOOR)) | (
        (m["rank"] == 1) & (m["score"] >= SECOND_FLOOR) & (m["score"] >= F.lit(SECOND_RATIO) * best)))
    return profiles.select(
        *[c for c in profiles.columns if c not in ("scores", "mood_ids")], F.explode(kept).alias("m")
    ).select("*", "m.mood", "m.rank", "m.score").drop("m")


def mood_index_sizes(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries per mood, thin pools flagged."""
    counts = index.groupBy(F.col("mood").alias("label_id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return labels.select("label_id").join(counts, "label_id", "left").select(
        "label_id", n.alias("entries"), (n < THIN_POOL).alias("thin"))


def mood_pools(profiles: DataFrame, seed="pool") -> DataFrame:
    """Index entries numbered in random order inside each pool.

    Pools are single moods ``(mood, -1)`` and the songs two moods share ``(mood, other)``. A song is in at
    most two moods, so both kinds are exploded from its own row. Draws become equi-joins on the position.
    """
    mood_list = F.transform(F.slice(ranked_moods(F.col("scores")), 1, 2), lambda m: m["pos"])
    admitted = F.filter(mood_list, lambda p: dominant_flag(F.col("scores"), p, INDEX_FLOOR, SECOND_FLOOR, SECOND_RATIO))
    single = F.transform(admitted, lambda p: F.struct(p.alias("mood"), F.lit(-1).alias("other")))
    a, b = F.element_at("_in", 1), F.element_at("_in", 2)
    shared = F.when(F.size("_in") == 2, F.array(F.struct(a.alias("mood"), b.alias("other")),
                                              F.struct(b.alias("mood"), a.alias("other"))))
    rows = profiles.withColumn("_in", admitted).withColumn(
        "_pools", F.concat(single, F.coalesce(shared, F.array().cast("array<struct<mood:int,other:int>>"))))
    flat = rows.withColumn("p", F.explode("_pools")).select(
        *profiles.columns, F.col("p.mood").alias("mood"), F.col("p.other").alias("other"))
    return hash_positions(flat, seed, ["id"], groups=["mood", "other"])


def pool_sizes(pools: DataFrame) -> DataFrame:
    """Rows per pool; at most K*K rows."""
    return pools.groupBy("mood", "other").agg(F.count("*").alias("pool_n"))


def bridge_pool(index: DataFrame) -> DataFrame:
    """``(mood, other, id)``: songs in the pools of two moods; a song is in two pools at most."""
    others = index.select("id", F.col("mood").alias("other"))
    return index.select("id", "mood").join(others, "id").filter(F.col("mood") != F.col("other")).select("mood", "other", "id")


def parse_candidate(cands: DataFrame, dominant: bool) -> DataFrame:
    """Candidates that fit the wanted ``mood`` and ``language``, with ``mood_score``.

    Loose: a score above 0.15. Dominant: the admission rule of the mood index.
    """
    score = mood_score(F.col("scores"), F.col("mood"))
    rule = (dominant_flag(F.col("scores"), F.col("mood"), INDEX_FLOOR, SECOND_FLOOR, SECOND_RATIO)
            if dominant else score > LOOSE_FLOOR)
    return cands.withColumn("mood_score", score).filter(rule & language_fits(F.col("wanted"), F.col("language")))


def mood_score(scores: Column, mood: Column) -> Column:
    return F.coalesce(F.try_element_at(scores, (mood + 1).cast("int")), F.lit(0.0))


def language_fits(wanted: Column, language: Column) -> Column:
    return wanted.isNull() | (F.coalesce(language, F.lit("en")) == wanted)
