"""The stored index: recall at the calibrated probes, exactness with all probes, copies, new query vectors and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.operators import vector_index as V
from arcloom.operators.neighbours import knn_l2
from arcloom.plans import analytics_queries as Q
from tests.test_neighbours import brute, frame, got

ALL = V.Probes(10**6, 10**6, 1.0)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_of_the_registered_query(spark, sf):
    recall = Q.knn_recall(spark, f"/root/testdata/sf{sf}").first()["recall"]
    print("recall at", sf, recall)
    assert recall >= 0.9


def test_calibration_prunes_where_vectors_have_structure(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 10, (30, 1, 6)) + rng.normal(0, 0.5, (30, 60, 6))).reshape(-1, 6)
    ids = [int(i) for i in rng.permutation(len(x))]
    songs = frame(spark, ids, x)
    index = V.load_index(spark, V.build_index(songs, 8, cell_rows=30).path)
    probes = V.calibrate(spark, index)
    want = {i: {d for d, _ in v} for i, v in brute(ids, x, 8).items()}
    found = got(V.knn_approx(songs, 8, index=index, probes=probes))
    recall = np.mean([len({d for d, _ in found[i]} & want[i]) / 8 for i in ids])
    assert recall >= 0.9 and probes.recall >= 0.92 and probes.cells < index.table(spark, "pivots").count() / 4
    few = V.calibrate(spark, index, 8, 0.5)
    assert few.cells <= probes.cells and few.recall >= 0.52


def test_all_probes_are_exact_with_copies_and_texts_as_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (150, 4))
    x[::3] = x[0]
    x[1::7] = x[1]
    ids = [f"s{i:03d}" for i in range(len(x))]
    songs = frame(spark, ids, x)
    index = V.build_index(songs, 5, cell_rows=10)
    assert got(V.knn_approx(songs, 5, index=index, probes=ALL)) == brute(ids, x, 5)
    some = spark.createDataFrame([("s003",), ("s008",), ("none",)], "id string")
    part = got(V.knn_approx(songs, 3, index=index, probes=ALL, queries=some))
    assert part == {i: v for i, v in brute(ids, x, 3).items() if i in ("s003", "s008")}


def test_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(V, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (120, 3))
    ids = list(range(120))
    assert got(V.knn_approx(frame(spark, ids, x), 6, cell_rows=25, probes=ALL)) == brute(ids, x, 6)


def test_new_vectors_and_too_many_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (90, 3))
    index = V.build_index(frame(spark, list(range(90)), x), 4, cell_rows=10)
    new = rng.normal(0, 1, (5, 3))
    queries = spark.createDataFrame([(f"q{i}", [float(v) for v in r]) for i, r in enumerate(new)] + [("null", None)], "query string, embedding array<double>")
    rows = V.search(index, queries, 3, ALL).collect()
    for i, q in enumerate(new):
        d = np.round(np.sqrt(((x - q) ** 2).sum(1)), 6)
        assert [r["id"] for r in sorted((r for r in rows if r["query"] == f"q{i}"), key=lambda r: (r["dist"], r["id"]))] == np.lexsort((np.arange(90), d))[:4].tolist()
    assert {r["query"] for r in rows} == {f"q{i}" for i in range(5)}
    with pytest.raises(ValueError):
        V.search(index, queries, 5, ALL)


def test_tiny_and_empty_tables(spark):
    x = np.array([[0.0, 1.0], [1.0, 1.0], [5.0, 0.0]])
    songs = frame(spark, [1, 2, 3], x)
    assert got(V.knn_approx(songs, 10)) == brute([1, 2, 3], x, 10)
    empty = songs.filter(F.lit(False))
    assert V.knn_approx(empty, 3).count() == 0
    nulls = songs.withColumn("embedding", F.when(F.col("id") > 1, F.col("embedding")))
    assert got(V.knn_approx(nulls, 2)) == got(knn_l2(nulls, 2))
