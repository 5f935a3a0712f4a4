"""Candidate tiers, draws and whole walks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.operators import playlist as P
from arcloom.operators.graphs import scored_neighbours
from arcloom.operators.moods import mood_pools, pool_sizes
from arcloom.sources.workspace import store

K = 3


@pytest.fixture(scope="module")
def world(spark):
    """120 songs around three moods, a third of them in French."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(120):
        mood = i % K
        vec = rng.normal(0, 0.6, K)
        vec[mood] += 2
        share = np.exp(2.5 * vec) / np.exp(2.5 * vec).sum()
        rows.append((i, [float(v) for v in vec], "fr" if i % 3 == 0 and i % 2 == 0 else "en", [round(float(s), 4) for s in share], [0, 1, 2]))
    songs = store(spark.createDataFrame(rows, "id long, embedding array<double>, language string, scores array<double>, mood_ids array<int>"), "songs")
    pools = store(mood_pools(songs), "pools")
    near = store(P.neighbour_table(scored_neighbours(songs, 60), songs, k=20), "near")
    return {"songs": songs, "pools": pools, "sizes": store(pool_sizes(pools), "sizes"), "near": near,
            "moods": {r[0]: r[3] for r in rows}, "lang": {r[0]: r[2] for r in rows}}


def requests(spark, n=12):
    arcs = [[0], [0, 1], [2, 0, 1], [1, 2]]
    rows = [(i, arcs[i % 4], 0.05 + 0.1 * (i % 5), 5 + i % 4, "en" if i % 3 == 1 else None) for i in range(n)]
    return spark.createDataFrame(rows, "request_id long, arc array<int>, temperature double, playlist_len int, wanted string")


def walk(spark, world, profile="batch", asked=None, seed="w"):
    asked = requests(spark) if asked is None else asked
    seeds = P.seed_random(asked, world["pools"], world["sizes"], world["songs"])
    return P.generate_playlists(asked, seeds, world["near"], world["pools"], world["sizes"], profile, seed)


@pytest.mark.parametrize("profile, extra", [("batch", 0), ("service", 1)])
def test_walk_invariants(spark, world, profile, extra):
    asked = {r["request_id"]: r for r in requests(spark).collect()}
    plan = {}
    for r in P.zone_plan(requests(spark), profile).collect():
        plan.setdefault(r["request_id"], []).append((r["mood"], r["zone_len"]))
    lists = {}
    for r in walk(spark, world, profile).orderBy("request_id", "pos").collect():
        lists.setdefault(r["request_id"], []).append(r)
    assert set(lists) == set(asked)
    for rid, songs in lists.items():
        ids = [s["id"] for s in songs]
        assert len(ids) == len(set(ids)) == asked[rid]["playlist_len"] + extra
        assert [s["pos"] for s in songs] == list(range(len(songs)))
        want = [m for m, n in sorted(plan[rid], key=lambda z: asked[rid]["arc"].index(z[0])) for _ in range(n)]
        assert [s["mood"] for s in songs[1:]] == want
        for s in songs[1:]:
            score = world["moods"][s["id"]][s["mood"]]
            if not s["bridge"]:
                assert score > 0.15
                assert asked[rid]["wanted"] in (None, world["lang"][s["id"]])


def test_walk_is_repeatable_under_other_partitionings(spark, world):
    first = sorted(map(tuple, walk(spark, world).select("request_id", "pos", "id").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = walk(spark, world, asked=requests(spark).repartition(5))
        assert sorted(map(tuple, again.select("request_id", "pos", "id").collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    seeds = P.seed_random(requests(spark), world["pools"], world["sizes"], world["songs"])
    plain = P.generate_playlists(requests(spark), seeds, world["near"], world["pools"], world["sizes"], seed="w")
    assert sorted(map(tuple, plain.select("request_id", "pos", "id").collect())) == first
    other = sorted(map(tuple, walk(spark, world, seed="z").select("request_id", "pos", "id").collect()))
    assert other != first


def test_zone_without_songs_is_skipped(spark, world):
    """No song speaks Klingon, so every zone is skipped and only the seed remains."""
    asked = requests(spark, 4).withColumn("wanted", F.lit("tlh"))
    assert walk(spark, world, asked=asked).groupBy("request_id").count().filter("count <> 1").isEmpty()


def test_short_playlist_over_a_long_arc(spark, world):
    asked = spark.createDataFrame([(1, [0, 1, 2, 0, 1, 2], 0.1, 5, None)], requests(spark).schema)
    rows = walk(spark, world, asked=asked).orderBy("pos").collect()
    assert [r["mood"] for r in rows] == [None, 0, 1, 2, 0]


def test_seed_prefers_language_then_pool_then_first_song(spark, world):
    asked = spark.createDataFrame([(1, [0], 0.1, 5, "fr"), (2, [0], 0.1, 5, "tlh"), (3, [9], 0.1, 5, None)], requests(spark).schema)
    got = {r["request_id"]: r["id"] for r in P.seed_random(asked, world["pools"], world["sizes"], world["songs"]).collect()}
    pool = {r["id"] for r in world["pools"].filter("mood = 0 and other = -1").collect()}
    assert world["lang"][got[1]] == "fr" and {got[1], got[2]} <= pool and got[3] == 0


def micro(spark):
    """Song 0 with hand-made neighbours: (rank, id, graph, direct, language, scores)."""
    near = [(1, 1, 0.9, 0.9, "en", [0.5, 0.45]), (2, 2, 0.8, 0.8, "en", [0.15, 0.7]), (3, 3, 0.7, 0.7, "fr", [0.6, 0.41]),
            (4, 4, None, 0.6, "en", [0.1501, 0.2]), (5, 5, None, 0.5, "en", [0.4, 0.4]), (6, 6, None, 0.4, "en", [0.9, 0.1])]
    kind = "array<struct<rank:int,id:bigint,graph:double,direct:double,language:string,scores:array<double>>>"
    return spark.createDataFrame([(0, [1.0, 0.0], near)], f"current long, current_vec array<double>, near {kind}")


def state(spark, played, wanted=None, mood=0, next_mood=1):
    return spark.createDataFrame([(1, 0, mood, next_mood, played, wanted)],
                                 "request_id long, current long, mood int, next_mood int, played array<long>, wanted string")


def pool_of(spark, rows):
    pools = spark.createDataFrame(rows, "mood int, other int, pos long, id long, language string, scores array<double>, embedding array<double>").withColumn("pos_n", F.lit(2))
    return pools, pool_sizes(pools)


def ids(df):
    return [r["id"] for r in df.orderBy("nth").collect()]


def test_graph_tier(spark):
    assert ids(P.candidates_graph(state(spark, [0]), micro(spark))) == [3, 1]
    assert ids(P.candidates_graph(state(spark, [0, 3]), micro(spark))) == [1]
    assert ids(P.candidates_graph(state(spark, [0], "en"), micro(spark))) == [1]
    assert ids(P.candidates_graph(state(spark, [0]), micro(spark), "service")) == [1, 3]


def test_near_tier(spark):
    assert ids(P.candidates_ann(state(spark, [0, 6]), micro(spark))) == [3, 1, 5, 4]
    assert ids(P.candidates_ann(state(spark, [0]), micro(spark), "service")) == [1, 3, 4, 5, 6]


def test_tiers_fall_through(spark):
    pools, sizes = pool_of(spark, [(0, -1, 0, 8, "en", [0.95, 0.0], [0.0, 1.0]), (0, -1, 1, 6, "en", [0.9, 0.1], [1.0, 0.0])])
    two = P.candidates_tiered(state(spark, [0]), micro(spark), pools, sizes)
    assert {(r["id"], r["source"]) for r in two.collect()} == {(3, "graph"), (1, "graph"), (6, "near"), (5, "near"), (4, "near")}
    three = P.candidates_tiered(state(spark, [0, 3, 4, 5]), micro(spark), pools, sizes)
    assert {(r["id"], r["source"]) for r in three.collect()} == {(1, "graph"), (6, "near"), (8, "pool")}
    assert {r["id"]: r["direct"] for r in three.collect()}[8] == 0.0


def test_bridges(spark):
    pools, sizes = pool_of(spark, [(0, 1, 0, 9, "en", [0.5, 0.42], [1.0, 0.0]), (0, 1, 1, 10, "en", [0.5, 0.4], [1.0, 0.0])])
    got = P.bridge_candidates(state(spark, [0]), micro(spark), pools, sizes)
    assert [(r["id"], round(r["mood_score"], 6)) for r in got.orderBy("nth").collect()] == [(3, 0.505), (1, 0.475)]
    # No graph bridge left: edges remain, so near songs are not consulted, and the shared pool decides.
    assert ids(P.bridge_candidates(state(spark, [0, 1, 3]), micro(spark), pools, sizes)) == [9]
    # No edges left: near songs are consulted; 0.4 itself is not enough there.
    assert ids(P.bridge_candidates(state(spark, [0, 1, 2, 3, 9]), micro(spark), pools, sizes)) == []
    assert ids(P.bridge_candidates(state(spark, [0, 1, 3]), micro(spark), pools, sizes, profile="service")) == []


def test_pool_draws_are_distinct_and_whole_for_small_pools(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 59, 60, 61, 1000, 10**9])], "k long, n long")
    rows = df.select("n", P._draw_positions(F.col("n"), F.lit(60), "s", "k").alias("d")).collect()
    for r in rows:
        assert len(r["d"]) == len(set(r["d"])) == min(r["n"], 60)
        assert all(0 <= p < r["n"] for p in r["d"])


def test_softmax_draw_follows_the_probabilities(spark):
    scores = {1: 0.5, 2: 0.4, 3: 0.1}
    df = spark.range(6000).select(F.col("id").alias("request_id"), F.explode(F.create_map(
        *[F.lit(x) for kv in scores.items() for x in kv])).alias("id", "score"))
    got = {r["id"]: r["count"] / 6000 for r in P.softmax_sample(df, F.lit(0.2), "s").groupBy("id").count().collect()}
    weights = {k: np.exp(v / 0.2) for k, v in scores.items()}
    for k, w in weights.items():
        assert abs(got[k] - w / sum(weights.values())) < 0.02
    total = P.softmax_probs(df.filter("request_id < 5"), F.lit(0.2)).groupBy("request_id").agg(F.sum("prob")).collect()
    assert all(abs(r[1] - 1) < 1e-12 for r in total)


def test_flattening(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.3), (1, 3, 0.2), (2, 1, 0.9), (3, 1, -0.5), (3, 2, -0.1), (3, 3, 0.4)],
                               "request_id long, id long, score double")
    cap = {(r["request_id"], r["id"]): round(r["score"], 6) for r in P.median_cap(df).collect()}
    assert cap == {(1, 1): 0.45, (1, 2): 0.3, (1, 3): 0.2, (2, 1): 0.9, (3, 1): -0.5, (3, 2): -0.1, (3, 3): 0.4}
    damp = {(r["request_id"], r["id"]): round(r["score"], 6) for r in P.sqrt_damp(df).collect()}
    assert damp[1, 1] == round(0.9 ** 0.5, 6) and damp[2, 1] == 0.9
    tied = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9)], "request_id long, id long, score double")
    assert {r["score"] for r in P.sqrt_damp(tied).collect()} == {0.9}


def test_row_draw_equals_the_relational_draw(spark):
    """The draw inside the row and median_cap + softmax_sample choose alike."""
    cands = [(1, i, 0.1 * i, 0.05 * i) for i in range(1, 8)]
    flat = spark.createDataFrame(cands, "request_id long, id long, transition double, mood_score double")
    entry = F.struct(F.lit(0.0).alias("ord"), "id", "mood_score", F.col("transition").alias("graph"), F.col("transition").alias("direct"), F.lit("graph").alias("source"))
    rows = flat.groupBy("request_id").agg(F.collect_list(entry).alias("cands")).withColumn("temperature", F.lit(0.3))
    drawn = P._with_draw(rows, P.PROFILES["batch"], F.lit(0.55), "d", "request_id").first()["drawn"]
    capped = P.median_cap(P.blend_scores(flat.withColumn("alpha", F.lit(0.55))))
    assert P.softmax_sample(capped, F.lit(0.3) + 1e-8, "d").first()["id"] == drawn["id"]


def test_requests_are_checked(spark):
    labels = spark.createDataFrame([(0, "calm"), (1, "wild")], "label_id int, label string")
    rows = [(1, ["calm"], 0.05, 5), (2, [], 0.1, 6), (3, ["wild", "odd"], 3.01, 51)]
    df = spark.createDataFrame(rows, "request_id long, arc array<string>, temperature double, playlist_len int")
    got = {r["request_id"]: r["errors"] for r in P.validate_requests(df, labels).collect()}
    assert got == {1: [], 2: ["empty arc"], 3: ["unknown moods: odd", "temperature out of range", "length out of range"]}
    assert {r["request_id"]: r["arc"] for r in P.arc_positions(df, labels).collect()} == {1: [0]}


def test_a_step_moves_the_state_and_not_the_neighbour_lists(spark, world):
    from arcloom.sources.workspace import store_by_key

    songs, near = world["songs"], world["near"]
    kept, table = store_by_key(near, "near", "current")
    state = songs.select(F.col("id").alias("request_id"), F.col("id").alias("current"), F.array("id").alias("played"))
    plan = P._with_near(state, kept.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(current") == 1 and "Bucketed: true" in plan
    want = {r["request_id"]: r["near"] for r in P._with_near(state, near).collect()}
    assert {r["request_id"]: r["near"] for r in P._with_near(state, kept).collect()} == want
    spark.sql(f"DROP TABLE {table}")


def test_busy_songs_are_joined_like_the_others(spark, world, monkeypatch):
    near = world["near"]
    state = spark.createDataFrame([(i, [0, 0, 0, 1, None][i % 5], [i]) for i in range(50)], "request_id long, current long, played array<long>")
    monkeypatch.setattr(P, "BUSY_ROWS", 5)
    monkeypatch.setattr(P, "BUSY_SONGS", 2)
    busy = P._busy_songs(state, 50)
    assert busy == [0] and P._busy_songs(state, 5) == []
    rows = [sorted((r["request_id"], r["current"], len(r["near"])) for r in P._with_near(state, near, busy=b).collect()) for b in ((), busy)]
    assert rows[0] == rows[1] and len(rows[0]) == 50
