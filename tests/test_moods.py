"""Threshold edges of the mood rules, clusters and silhouettes."""

import json

import numpy as np

from pyspark.sql import functions as F

from arcloom.functions import moods as M
from arcloom.operators import centroids as K
from arcloom.operators import clustering as L
from arcloom.operators import moods as O


def profiles(spark, scores):
    rows = [(i, [float(x) for x in s], list(range(len(s)))) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "id long, scores array<double>, mood_ids array<int>")


def test_index_thresholds(spark):
    cases = [[0.30, 0.2], [0.2999, 0.2], [0.45, 0.40], [0.46, 0.39], [0.5, 0.425], [0.5, 0.4249], [0.4, 0.4], [0.31, 0.31]]
    got = sorted((r["id"], r["mood"], r["rank"]) for r in O.mood_index(profiles(spark, cases)).collect())
    assert got == [(0, 0, 0), (2, 0, 0), (2, 1, 1), (3, 0, 0), (4, 0, 0), (4, 1, 1), (5, 0, 0), (6, 0, 0), (6, 1, 1), (7, 0, 0)]


def test_index_rule_and_dominant_candidate_agree(spark):
    cases = [[0.30, 0.2, 0.1], [0.45, 0.40, 0.1], [0.5, 0.425, 0.1], [0.1, 0.5, 0.45], [0.2, 0.2, 0.2]]
    df = profiles(spark, cases)
    index = {(r["id"], r["mood"]) for r in O.mood_index(df).collect()}
    cands = df.withColumn("mood", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumns(
        {"wanted": F.lit(None).cast("string"), "language": F.lit("en")})
    assert {(r["id"], r["mood"]) for r in O.parse_candidate(cands, True).collect()} == index


def test_loose_rule_and_language(spark):
    df = profiles(spark, [[0.15], [0.1501]]).withColumns({"mood": F.lit(0), "language": F.lit(None).cast("string")})
    fits = O.parse_candidate(df.withColumn("wanted", F.lit("en")), False)
    assert [r["id"] for r in fits.collect()] == [1]
    assert O.parse_candidate(df.withColumn("wanted", F.lit("fr")), False).count() == 0


def test_pools_hold_index_and_shared_songs(spark):
    df = profiles(spark, [[0.45, 0.41, 0.1], [0.9, 0.0, 0.1], [0.1, 0.5, 0.45]])
    rows = {(r["mood"], r["other"]): set() for r in O.mood_pools(df).collect()}
    for r in O.mood_pools(df).collect():
        rows[r["mood"], r["other"]].add(r["id"])
    assert rows == {(0, -1): {0, 1}, (1, -1): {0, 2}, (2, -1): {2}, (0, 1): {0}, (1, 0): {0}, (1, 2): {2}, (2, 1): {2}}


def test_profile_json(spark):
    rows = [(json.dumps({"b": 0.5, "a": 0.25}),), (None,), ("broken",)]
    df = spark.createDataFrame(rows, "j string").select(M.mood_vector(M.parse_mood_scores(F.col("j")), F.array(F.lit("a"), F.lit("z"))).alias("v"))
    assert [r["v"] for r in df.collect()] == [[0.25, 0.0], [0.0, 0.0], [0.0, 0.0]]


def songs(spark, x, labels=None):
    labels = labels or [0] * len(x)
    return spark.createDataFrame([(i, [float(v) for v in row], l) for i, (row, l) in enumerate(zip(x, labels))],
                                 "id long, embedding array<double>, label_id int")


def test_scores_sum_to_one_and_nearest_is_top(spark):
    df = songs(spark, [[0, 0], [9, 9]])
    cents = spark.createDataFrame([(3, [0.0, 1.0]), (7, [9.0, 8.0])], "label_id int, centroid array<double>")
    rows = K.mood_scores(df, cents).collect()
    for song, label in ((0, 3), (1, 7)):
        mine = {r["label_id"]: r["score"] for r in rows if r["song_id"] == song}
        assert abs(sum(mine.values()) - 1) < 1e-3 and max(mine, key=mine.get) == label


def test_similarity_of_collinear_points(spark):
    cents = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.0])], "label_id int, centroid array<double>")
    got = {(r["i"], r["j"]): round(r["sim"], 6) for r in K.centroid_similarity(cents).collect()}
    assert got == {(0, 1): 0.5, (1, 2): 0.5, (0, 2): 0.0}


def test_inertia_never_grows(spark):
    rng = np.random.default_rng(0)
    df = songs(spark, rng.normal(0, 1, (90, 3)))
    cents = df.limit(4).select(F.col("id").cast("int").alias("label_id"), F.col("embedding").alias("centroid"))
    last = None
    for _ in range(4):
        assigned = K.kmeans_assign(df.drop("label_id"), cents)
        cost = K.kmeans_inertia(assigned, cents).first()[0]
        assert last is None or cost <= last + 1e-9
        last, cents = cost, K.kmeans_update(assigned)


def test_silhouette_brute_force_and_singleton(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (20, 2)), rng.normal(4, 1, (15, 2)), [[50.0, 50.0]]])
    lab = [0] * 20 + [1] * 15 + [2]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i, l in enumerate(lab):
        own = [j for j in range(len(x)) if lab[j] == l and j != i]
        if not own:
            want.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j in range(len(x)) if lab[j] == m]].mean() for m in set(lab) - {l})
        want.append((b - a) / max(a, b))
    row = L.silhouette(songs(spark, x, lab)).first()
    assert row["n"] == 36 and abs(row["silhouette"] - np.mean(want)) < 1e-6


def test_pick_best_k_finds_three_blobs(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    best, history = L.pick_best_k(songs(spark, x).drop("label_id"), 2, 5, n_init=3, max_iter=20)
    assert best == 3 and history.count() == 4
