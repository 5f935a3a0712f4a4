"""Answers that once depended on a limit: all rows count, every draw hits, every song gets its neighbours."""

import numpy as np
from pyspark.sql import functions as F

from arcloom.operators import centroids as K
from arcloom.operators import clustering as L
from arcloom.operators import pairs as R
from arcloom.operators.neighbours import knn_l2
from arcloom.operators.vector_index import Probes, knn_approx
from arcloom.sources import tables


def frame(spark, x, labels):
    rows = [(i, None if v is None else [None if a is None else float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id long, embedding array<double>, label_id int")


def test_silhouette_counts_5000_rows(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 5000)
    x = rng.normal(size=(5000, 4)) + labels[:, None] * 1.5
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    sums = np.stack([d[:, labels == c].sum(1) for c in range(3)], 1)
    n = np.bincount(labels)
    own = sums[np.arange(5000), labels] / (n[labels] - 1)
    others = sums / n
    others[np.arange(5000), labels] = np.inf
    want = ((others.min(1) - own) / np.maximum(own, others.min(1))).mean()
    row = L.silhouette(frame(spark, x, labels)).first()
    assert row["n"] == 5000 and abs(row["silhouette"] - want) < 1e-9
    assert L.silhouette(frame(spark, x, labels), size=100).first()["n"] == 100


def test_silhouette_of_few_rows(spark):
    assert L.silhouette(frame(spark, [], [])).first()["n"] == 0
    assert L.silhouette(frame(spark, [[0.0], [1.0], None], [0, 0, 1])).first()["silhouette"] == 0.0


def test_negative_pairs_always_hit(spark):
    songs = frame(spark, [[0.0]] * 1000, [0] * 995 + [1] * 5).select("id", "label_id")
    rows = R.negative_pairs(songs, 500).collect()
    assert sorted(r["draw"] for r in rows) == list(range(500))
    assert all((r["a"] < 995) != (r["b"] < 995) for r in rows)
    assert R.negative_pairs(songs.filter("label_id = 0"), 20).count() == 0


def test_approximate_neighbours_of_tiny_groups(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 8)) * 50, 5, axis=0) + rng.normal(size=(200, 8)) * 0.01
    got = knn_approx(frame(spark, x, [0] * 200), 10, cell_rows=5, probes=Probes(1, 1, 0.0)).groupBy("src").count().collect()
    assert len(got) == 200 and all(r["count"] == 10 for r in got)


def test_null_and_ragged_vectors(spark):
    songs = frame(spark, [[0.0, 0.0], None, [1.0, 1.0], [5.0], [2.0, None], [0.0, 1.0]], [0] * 6)
    moods = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0])], "label_id int, centroid array<double>")
    got = {r["id"]: r["label_id"] for r in K.kmeans_assign(songs.select("id", "embedding"), moods).collect()}
    assert got == {0: 0, 1: None, 2: 1, 3: None, 4: None, 5: 0}
    assert {r["song_id"] for r in K.mood_scores(songs, moods).filter(F.col("score").isNotNull()).collect()} == {0, 2, 5}
    even = songs.filter("id <> 3")
    assert {r["src"] for r in knn_l2(even, 2).collect()} == {0, 2, 5}


def test_one_update_per_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 3)], "id long, v string, w int")
    got = sorted(map(tuple, tables.update_metadata(old, new, "id", [F.desc("w")]).collect()))
    assert got == [(1, "y", 2), (2, "b", None)]


def test_neighbours_of_some_songs_only(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(150, 6)), np.repeat(rng.normal(size=(1, 6)), 20, axis=0)])
    songs = frame(spark, x, [0] * 170)
    some = spark.createDataFrame([(i,) for i in (3, 3, 60, 155, 169, 999)], "id long")
    for search in ({}, {"cell_rows": 20}):
        whole = knn_l2(songs, 4).filter(F.col("src").isin(3, 60, 155, 169))
        part = knn_l2(songs, 4, queries=some, **search)
        assert sorted(map(tuple, part.select("src", "dst", "rank").collect())) == sorted(map(tuple, whole.select("src", "dst", "rank").collect()))
