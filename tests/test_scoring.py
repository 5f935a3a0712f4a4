"""The network as matrices against the fitted pipeline, candidate scores, and the walk with a fitted classifier."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.operators import graphs as G
from arcloom.operators import playlist as P
from arcloom.operators import scoring as S
from arcloom.operators import transition as T
from arcloom.operators.features import pair_features
from arcloom.operators.moods import mood_pools, pool_sizes
from arcloom.sources.workspace import store

DIMS = 4


@pytest.fixture(scope="module")
def songs(spark):
    """Songs of two moods in two clusters."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(80):
        side = i % 2
        vector = rng.normal(3.0 * side, 1.0, DIMS)
        high = float(rng.uniform(0.7, 0.9))
        rows.append((i, [float(v) for v in vector], float(rng.uniform(80, 140)), float(rng.uniform()), float(vector[0]), "en",
                     [1 - high, high] if side else [high, 1 - high], [0, 1]))
    return spark.createDataFrame(rows, "id long, embedding array<double>, tempo double, energy double, valence double, language string, scores array<double>, mood_ids array<int>")


@pytest.fixture(scope="module")
def fitted(spark, songs):
    rng = np.random.default_rng(12)
    pairs = [(i, int(a), int(b), int(a % 2 == b % 2), "val" if i % 5 == 0 else "train") for i, (a, b) in enumerate(rng.integers(0, 80, (600, 2)))]
    rows = store(pair_features(spark.createDataFrame(pairs, "row_id long, a long, b long, label int, split string"), songs), "pairs")
    model, history = T.train_transition_model(rows, epochs=12, steps=10, hidden=[8])
    return rows, model


def test_matrices_equal_the_pipeline(spark, songs, fitted):
    rows, model = fitted
    network = S.network_of(model, DIMS)
    ours = {(r["a"], r["b"]): r["score"] for r in S.pair_scorer(songs, network)(rows.select("a", "b").distinct()).collect()}
    for r in T.model_scores(model, rows).collect():
        assert abs(ours[r["a"], r["b"]] - r["score"]) < 1e-9
    scored = T.model_scores(model, rows.filter("split = 'val'"))
    assert T.roc_auc(scored).first()["auc"] > 0.95


def test_only_what_is_needed_is_scored(spark, songs, fitted):
    scorer = S.pair_scorer(songs, S.network_of(fitted[1], DIMS))
    cands = spark.createDataFrame([(1, 0, 2, 0.5), (1, 0, 3, None), (2, 1, 2, None), (2, 1, 99, 0.25)], "request_id long, current long, id long, graph_score double")
    batch = {(r["current"], r["id"]): r["transition"] for r in P.score_candidates(cands, "batch", scorer).collect()}
    service = {(r["current"], r["id"]): r["transition"] for r in P.score_candidates(cands, "service", scorer).collect()}
    assert batch[0, 2] == 0.5 and batch[1, 99] == 0.25 and batch[0, 3] == service[0, 3] and service[0, 2] > 0.9 > 0.1 > service[0, 3]


def test_missing_states_have_no_score(spark):
    network = S.linear_network(2, np.ones(2 + 2 + 3 + 4), -1.0)
    score = S.state_scorer(spark, network)
    rows = spark.createDataFrame([(1, [0.0] * 7, [1.0] * 7), (2, None, [1.0] * 7), (3, [0.0] * 6, [1.0] * 7), (4, [0.0] * 7, [1.0, None] + [1.0] * 5)], "i int, a array<double>, b array<double>")
    got = {r["i"]: r["s"] for r in rows.select("i", score("a", "b").alias("s")).collect()}
    assert abs(got[1] - 1 / (1 + np.exp(-(2 + 3 + 2 - 1)))) < 1e-12 and got[2] is got[3] is got[4] is None


@pytest.mark.parametrize("profile", ["batch", "service"])
def test_walk_uses_the_classifier(spark, songs, fitted, profile):
    network = S.network_of(fitted[1], DIMS)
    states = songs.withColumn("embedding", S.state_of())
    lists = G.scored_neighbours(songs.select("id", "embedding"), P.NEAREST_KEPT, S.pair_scorer(songs, network))
    near = P.neighbour_table(lists, states)
    pools = store(mood_pools(states.select("id", "embedding", "language", "scores", "mood_ids")), "pools")
    asked = spark.createDataFrame([(i, [i % 2, 1 - i % 2], 0.2, 8, None) for i in range(12)], "request_id long, arc array<int>, temperature double, playlist_len int, wanted string")
    seeds = asked.select("request_id", F.col("request_id").alias("id"))
    rows = P.generate_playlists(asked, seeds, near, pools, pool_sizes(pools), profile, scorer=S.state_scorer(spark, network)).collect()
    data = {r["id"]: np.concatenate([r["embedding"], [r["tempo"], r["energy"], r["valence"]], r["scores"]]) for r in songs.collect()}
    moods = {r["id"]: r["scores"] for r in songs.collect()}
    lists_of = {}
    for r in sorted(rows, key=lambda r: (r["request_id"], r["pos"])):
        lists_of.setdefault(r["request_id"], []).append(r)
    assert len(lists_of) == 12
    checked = 0
    for picks in lists_of.values():
        assert len({r["id"] for r in picks}) == len(picks) == 8 + (profile == "service")
        for before, now in zip(picks, picks[1:]):
            if now["bridge"]:
                continue
            zone = (8 + (profile == "service")) // 2
            alpha = 0.4 if now["pos"] <= zone else 0.7
            p = network.probability(data[before["id"]][None], data[now["id"]][None])[0]
            stored = round(p, 4) if now["source"] == "graph" and profile == "batch" else p
            want = (1 - alpha) * stored + alpha * moods[now["id"]][now["mood"]]
            assert abs(want - now["score"]) < 1e-6, (profile, now, want)
            checked += 1
    assert checked > 60


@pytest.mark.parametrize("kind", ["long", "string"])
def test_the_grid_equals_the_joins(spark, kind, monkeypatch):
    """Repeated songs, songs without a state, unknown and null ids; the states travel to the grid and not with the pairs."""
    rng = np.random.default_rng(13)
    rows = [(i % 30, [float(v) for v in rng.normal(0, 1, 2)] if i != 7 else None, 1.0, 2.0, float(i), [0.5, 0.5]) for i in range(33)]
    songs = spark.createDataFrame(rows, "id long, embedding array<double>, tempo double, energy double, valence double, scores array<double>").withColumn("id", F.col("id").cast(kind))
    pairs = [(int(a), int(b), n) if n % 50 else (None, int(b), n) for n, (a, b) in enumerate(rng.integers(0, 34, (400, 2)))]
    pairs = spark.createDataFrame(pairs, "a long, b long, n int").withColumns({"a": F.col("a").cast(kind), "b": F.col("b").cast(kind)})
    scorer, out = S.pair_scorer(songs, S.linear_network(2, np.linspace(-1, 1, 11), 0.1)), []
    for side in (3, 1000):
        monkeypatch.setattr(S, "GRID_SIDE", side)
        found = scorer(pairs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("MapInArrow" in plan) == (side == 3) and found.columns == ["b", "a", "n", "score"]
        out.append(sorted((r["n"], r["a"], r["b"], -1 if r["score"] is None else round(r["score"], 9)) for r in found.collect()))
    assert out[0] == out[1] and len(out[0]) > 300 and any(r[3] == -1 for r in out[0])
