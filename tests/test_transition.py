"""Metrics on edge cases, the classifier and feature tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.operators import acoustic as A
from arcloom.operators import features as X
from arcloom.operators import pairs as R
from arcloom.operators import transition as T
from arcloom.operators.catalogue import train_val_test_split
from arcloom.sources import artefacts, tables
from arcloom.sources.workspace import store


def preds(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


@pytest.mark.parametrize("rows, want", [
    ([(1, 0.9), (0, 0.1)], 1.0), ([(1, 0.5), (0, 0.5)], 0.5), ([(1, 0.2), (0, 0.2), (0, 0.9)], 0.25), ([(1, 0.4), (1, 0.6)], None)])
def test_auc_small(spark, rows, want):
    assert T.roc_auc(preds(spark, rows)).first()["auc"] == want


def test_auc_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(T.roc_auc(preds(spark, rows)).first()["auc"] - want) < 1e-9


def test_metrics_without_predicted_positives(spark):
    row = T.classifier_metrics(preds(spark, [(1, 0.5), (0, 0.3)])).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 0, 1, 0)
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_bce_is_clamped(spark):
    assert T.bce_loss(preds(spark, [(1, 0.0), (0, 1.0)])).first()["bce"] == 100.0
    assert abs(T.bce_loss(preds(spark, [(1, 0.5)])).first()["bce"] - math.log(2)) < 1e-12


def test_bands(spark):
    df = preds(spark, [(0, 0.695), (0, 0.694), (0, 0.495), (0, 0.1), (0, None)])
    assert [r[0] for r in df.select(T.transition_band(F.col("score"))).collect()] == ["high", "mid", "mid", "low", None]


def blobs(spark, n=80):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(5 * (i % 2), 0.3, 4)], i % 2, 1.0, 0.5, 0.1, [0.7, 0.3]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, label_id int, tempo double, energy double, valence double, scores array<double>")


def test_classifier_learns_and_survives_saving(spark):
    from arcloom.operators.neighbours import knn_l2

    songs = blobs(spark)
    pos, neg = R.positive_pairs(songs, knn_l2(songs, 3), 150), R.negative_pairs(songs, 150)
    label = {r["id"]: r["label_id"] for r in songs.collect()}
    assert all(label[r["a"]] != label[r["b"]] for r in neg.collect())
    assert pos.count() == neg.count() == 150 and pos.filter("a = b").isEmpty()
    rows = X.pair_features(R.balance_shuffle(pos, neg), songs)
    assert R.pair_stats(rows).first()["dim"] == 4 + 4 + 3 + 2 + 2
    split = train_val_test_split(rows, "s", ["row_id"])
    model, history = T.train_transition_model(split, epochs=6, hidden=[8], steps=15)
    assert T.best_epoch(history).first()["val_loss"] == min(r["val_loss"] for r in history.collect())
    loaded = artefacts.load_transition_model(artefacts.save_model(model, spark, "mlp"))
    test = split.filter("split = 'test'")
    assert T.roc_auc(T.model_scores(loaded, test)).first()["auc"] > 0.9
    scored = T.score_transition(pos.select("a", "b"), songs, loaded)
    assert scored.filter((F.col("score") >= 0) & (F.col("score") <= 1)).count() == 150


def test_draws_cover_the_catalogue_evenly(spark):
    songs = blobs(spark, 20)
    knn = spark.createDataFrame([(i, (i + d) % 20, d) for i in range(20) for d in (1, 2, 3)], "src long, dst long, rank int")
    pairs = R.positive_pairs(songs, knn, 2000).collect()
    counts = {i: sum(r["a"] == i for r in pairs) for i in range(20)}
    assert min(counts.values()) > 60 and {(r["b"] - r["a"]) % 20 for r in pairs} == {1, 2, 3}


def test_scaler_zero_deviation(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id long, embedding array<double>")
    scaler = X.scaler_fit(df)
    assert [(r["mean"], r["std"]) for r in scaler.orderBy("pos").collect()] == [(2.0, 1.0), (5.0, 1.0)]
    assert [r["scaled"] for r in X.scaler_transform(df, artefacts.save_scaler(scaler)).orderBy("id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]


def test_principal_components_keep_the_main_axis(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(0, 1, 60)
    df = spark.createDataFrame([(i, [float(v), float(v + e), float(f)]) for i, (v, e, f) in enumerate(
        zip(t, rng.normal(0, 0.01, 60), rng.normal(0, 1, 60)))], "id long, embedding array<double>")
    out, model = X.reduce_dims(df, 2)
    assert model.explainedVariance.sum() > 0.99 and len(out.first()["reduced"]) == 2


def test_one_beat_gives_no_danceability(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("b", 1.0), ("b", 2.0), ("c", 0.0), ("c", 1.0), ("c", 10.0)], "track string, beat_time double")
    for span in (3600, 2):
        got = {r["track"]: r["danceability_proxy"] for r in A.danceability_proxy(df, span).collect()}
        assert got["a"] == 0.0 and got["b"] == 1.0 and abs(got["c"] - (1 - 4 / (5 + 1e-6))) < 1e-9


def test_tempo_rules(spark):
    rows = [(160.0, 0.25), (160.0, 0.26), (89.0, 0.21), (89.0, 0.20), (59.0, 0.1)]
    df = spark.createDataFrame(rows, "t double, e double")
    now = [r[0] for r in df.select(A.fix_tempo_octave(F.col("t"), F.col("e"))).collect()]
    old = [r[0] for r in df.select(A.fix_tempo_octave(F.col("t"), F.col("e"), "legacy")).collect()]
    assert now == [80.0, 160.0, 178.0, 89.0, 59.0] and old == [80.0, 160.0, 89.0, 89.0, 118.0]


def test_append_upsert_and_update(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "d")], "id long, v string")
    kept = sorted((r["id"], r["v"], r["inserted"]) for r in tables.append_new_rows(old, new, "id", ["v"]).collect())
    assert kept == [(1, "a", False), (2, "b", False), (3, "c", True)]
    stamp = F.to_timestamp(F.lit("2024-05-01"))
    up = {r["id"]: (r["v"], r["processed_at"] is not None) for r in tables.upsert_features(old, new, "id", stamp, [F.desc("v")]).collect()}
    assert up == {1: ("a", False), 2: ("x", True), 3: ("d", True)}
    merged = tables.update_metadata(old, spark.createDataFrame([(1, None, 9)], "id long, v string, w int"), "id")
    assert sorted(tuple(r) for r in merged.select("id", "v", "w").collect()) == [(1, "a", 9), (2, "b", None)]


def test_playlists_round_trip(spark):
    df = spark.createDataFrame([(r, p, f"s{p}") for r in range(30) for p in range(4)], "request_id long, pos int, id string")
    back = tables.write_playlists(df, buckets=4)
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert tables.playlist_json(df.filter("request_id = 1 and pos < 2")).first()["playlist"] == '[{"pos":0,"id":"s0"},{"pos":1,"id":"s1"}]'


def test_better_than_chance_on_the_fixture(spark):
    from arcloom.operators.neighbours import knn_l2
    from arcloom.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    songs = fx.vectors(spark, sf)
    pairs = R.balance_shuffle(R.positive_pairs(songs, knn_l2(songs, 3), 3000), R.negative_pairs(songs, 3000, label="label"))
    rows = store(X.pair_features(pairs, fx.profiles(spark, sf)), "pair-features")
    split = store(train_val_test_split(rows, "split", ["row_id"]), "split-pairs")
    model, history = T.train_transition_model(split, epochs=4, patience=4, hidden=[64], steps=10)
    assert history.columns == ["epoch", "train_loss", "val_loss", "val_auc", "val_acc"]
    assert T.roc_auc(T.model_scores(model, split.filter("split = 'test'"))).first()["auc"] > 0.5


def test_training_without_validation_rows(spark):
    rows = spark.createDataFrame([([float(i % 2), float(i)], i % 2, "train") for i in range(40)], "features array<double>, label int, split string")
    model, history = T.train_transition_model(rows, epochs=2, hidden=[4], steps=5)
    last = history.collect()[-1]
    assert last["val_loss"] is None and last["val_auc"] is None and last["train_loss"] is not None
    assert T.model_scores(model, rows).count() == 40


def test_partitions_of_the_training_follow_the_pairs(spark, monkeypatch):
    """Each one answers every step with a gradient, so many small files must not become many gradients for the driver."""
    seen, fit = [], T.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(T.MultilayerPerceptronClassifier, "fit", lambda self, df, *a: (seen.append(df.rdd.getNumPartitions()), fit(self, df, *a))[1])
    rows = [([float(i % 2), float(i)], i % 2, "val" if i % 5 == 0 else "train") for i in range(40)]
    pairs = spark.createDataFrame(rows, "features array<double>, label int, split string").repartition(16)
    T.train_transition_model(pairs, epochs=2, hidden=[4])
    assert seen == [1, 1]
