"""The 26 features of a track against numpy, missing parts, and the shape of the plan."""

import numpy as np
import pytest

from arcloom.operators import acoustic as A
from arcloom.schemas import FEATURES

TABLES = {
    "tempos": "track string, tempo double",
    "frames": "track string, rms double, centroid double, bandwidth double, rolloff double, contrast double, zcr double",
    "coefficients": "track string, bin int, value double", "chroma": "track string, bin int, value double",
    "beats": "track string, beat_time double", "spectrum": "track string, freq double, magnitude double",
}


def frames(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in TABLES.items()}


def found(tables):
    return {r["track"]: r.asDict() for r in A.feature_rows(**tables).collect()}


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rms, five = rng.random(50), rng.random((50, 5))
    mfcc, chroma, magnitude = rng.normal(size=(13, 40)), rng.random((12, 40)), rng.random((60, 7))
    beats = np.cumsum(rng.uniform(0.4, 0.6, 9000))
    freqs = np.arange(60) * 20.0
    tables = frames(
        spark, tempos=[("a", 80.0)], frames=[("a", float(r), *map(float, f)) for r, f in zip(rms, five)],
        coefficients=[("a", i, float(v)) for i in range(13) for v in mfcc[i]], chroma=[("a", i, float(v)) for i in range(12) for v in chroma[i]],
        beats=[("a", float(t)) for t in rng.permutation(beats)], spectrum=[("a", float(f), float(v)) for f, row in zip(freqs, magnitude) for v in row])
    got = found(tables)["a"]
    gaps = np.diff(beats)
    low, high = magnitude[freqs < 500].mean(), magnitude[freqs >= 500].mean()
    want = {
        "tempo": 160.0, "energy_mean": rms.mean(), "energy_std": rms.std(),
        "valence_proxy": (chroma[[0, 4, 7]].mean() - chroma[[0, 3, 7]].mean() + 1) / 2, "danceability_proxy": 1 - gaps.std() / (gaps.mean() + 1e-6),
        "acousticness_proxy": low / (low + high + 1e-6), "chroma_mean": chroma.mean(), "chroma_std": chroma.std(),
        **dict(zip(["spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_contrast", "zcr"], five.mean(0))),
        **{f"mfcc_{i + 1}": mfcc[i].mean() for i in range(13)}}
    assert list(got) == ["track", *FEATURES] and len(FEATURES) == 26
    assert {k: got[k] for k in FEATURES} == pytest.approx(want, rel=1e-9)


def test_missing_parts_nulls_and_empty_tables(spark):
    tables = frames(
        spark, tempos=[("t", 200.0), ("e", None)], frames=[("f", 0.1, None, 2.0, None, None, None), ("f", None, None, 4.0, None, None, None)],
        chroma=[("c", None, 0.5), ("c", 0, None)], beats=[("b", 1.0), ("r", 2.0), ("r", 2.0), ("n", None)], spectrum=[("s", None, 1.0), ("s", 100.0, 2.0), (None, 900.0, 1.0)])
    got = found(tables)
    assert set(got) == {"t", "e", "f", "c", "b", "r", "n", "s", None}
    assert got["t"]["tempo"] == 200.0 and got["e"]["tempo"] is None
    assert (got["f"]["energy_mean"], got["f"]["energy_std"], got["f"]["spectral_bandwidth"], got["f"]["zcr"]) == (0.1, 0.0, 3.0, None)
    assert got["c"]["chroma_mean"] == 0.5 and got["c"]["valence_proxy"] == 0.5 and got["t"]["valence_proxy"] is None
    assert (got["b"]["danceability_proxy"], got["r"]["danceability_proxy"], got["n"]["danceability_proxy"]) == (0.0, 1.0, 0.0)
    assert got["s"]["acousticness_proxy"] == pytest.approx(1.0, abs=1e-6) and got[None]["acousticness_proxy"] == 0.0
    assert got["t"]["acousticness_proxy"] is None
    assert found(frames(spark)) == {}


def test_only_partial_sums_are_shuffled_by_track(spark):
    rows = frames(spark, frames=[("a", 0.1, 1.0, 1.0, 1.0, 1.0, 1.0)], beats=[("a", 1.0)])
    plan = A.feature_rows(**rows)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan and "Join" not in plan
    assert plan.count("hashpartitioning(track") <= 4
