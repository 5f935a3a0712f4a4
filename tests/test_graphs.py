"""Connectivity, thresholds and cheapest paths on small graphs."""

import math
import random

import pytest

from arcloom.operators import graphs as G
from arcloom.sources import tables


def nodes(spark, ids):
    return spark.createDataFrame([(i, f"n{i}") for i in ids], "id int, label string")


def sims(spark, rows):
    return spark.createDataFrame(rows, "i int, j int, sim double")


def named(spark, ids):
    return spark.createDataFrame([(i, f"n{i}", "") for i in ids], "label_id int, label string, description string")


def test_line_is_connected_and_island_is_not(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "source int, target int")
    line = G.graph_connectivity(nodes(spark, range(5)), edges)
    assert line.filter("reachable").count() == 5
    reach = G.graph_connectivity(nodes(spark, range(7)), edges)
    row = G.connectivity_report(reach, edges).first()
    assert (row["nodes"], row["reached"], row["isolated"], row["connected"]) == (7, 5, "n5, n6", False)


def test_no_edges_means_not_connected(spark):
    edges = spark.createDataFrame([], "source int, target int")
    row = G.connectivity_report(G.graph_connectivity(nodes(spark, [4]), edges), edges).first()
    assert row["connected"] is False and row["reached"] == 1


def test_connection_strength_is_the_best_bottleneck(spark):
    rows = [(0, 1, 0.9), (1, 2, 0.5), (0, 2, 0.3), (2, 3, 0.8), (1, 3, 0.1)]
    got = {r["id"]: r["strength"] for r in G.connection_strength(nodes(spark, range(4)), sims(spark, rows)).collect()}
    assert got == {0: 2.0, 1: 0.9, 2: 0.5, 3: 0.5}


@pytest.mark.parametrize("weakest, threshold, connected, n_edges", [(0.75, 0.7, True, 2), (0.41, 0.4, True, 2),
                                                                    (0.2, 0.2, True, 2), (0.19, 0.2, False, 1)])
def test_auto_threshold(spark, weakest, threshold, connected, n_edges):
    df = G.auto_threshold(sims(spark, [(0, 1, 0.9), (1, 2, weakest), (0, 2, 0.0)]), named(spark, range(3)))
    rows = df.collect()
    assert len(rows) == n_edges and {(r["threshold"], r["connected"]) for r in rows} == {(threshold, connected)}


def test_adjacency_text(spark):
    edges = G.mood_graph(sims(spark, [(0, 1, 0.91234), (0, 2, 0.1)]), named(spark, range(3)))
    got = {r["label_id"]: r["connections"] for r in G.mood_graph_adjacency(named(spark, range(3)), edges).collect()}
    assert got == {0: "n1 (0.91)", 1: "n0 (0.91)", 2: "none"}


def test_export_and_import_adjacency(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9)], "src long, dst long, score double")
    lists = tables.export_adjacency(spark.range(1, 4), edges)
    got = {r["id"]: [(e["target"], e["score"]) for e in r["edges"]] for r in lists.collect()}
    assert got == {1: [(3, 0.9), (2, 0.5)], 2: [], 3: []}
    assert sorted(tuple(r) for r in tables.import_adjacency(lists).collect()) == [(1, 2, 0.5), (1, 3, 0.9)]


def shortest(links, start, max_steps):
    """Least (cost, path) per node over all simple paths of at most ``max_steps`` nodes."""
    best, todo = {}, [(0.0, (start,))]
    while todo:
        cost, path = todo.pop()
        here = path[-1]
        if here not in best or (cost, path) < best[here]:
            best[here] = (cost, path)
        if len(path) < max_steps:
            todo += [(cost + w, path + (v,)) for v, w in links.get(here, []) if v not in path]
    return best


@pytest.mark.parametrize("seed", range(4))
def test_paths_against_enumeration(spark, seed):
    rng = random.Random(seed)
    n, steps = 7, 4
    moods = {i: [rng.random(), rng.random()] for i in range(n)}
    edges = [(u, v, round(rng.random(), 3)) for u in range(n) for v in range(n) if u != v and rng.random() < 0.4]
    target = [1.0, 0.0]
    links = {}
    for u, v, s in edges:
        links.setdefault(u, []).append((v, (1 - s) + 0.4 * math.dist(moods[v], target)))
    edge_df = spark.createDataFrame(edges, "src long, dst long, score double")
    profile_df = spark.createDataFrame(list(moods.items()), "id long, scores array<double>")
    starts = spark.createDataFrame([(10 + i, i, target) for i in (0, 3)], "request_id long, start long, target array<double>")
    got = {r["request_id"]: (r["cost"], r["path"]) for r in G.mood_path(edge_df, profile_df, starts, steps).collect()}
    for s in (0, 3):
        best = shortest(links, s, steps)
        full = [b for b in best.values() if len(b[1]) == steps]
        want = min(full) if full else min(
            (round(math.dist(moods[v], target), 9), b) for v, b in best.items())[1]
        assert abs(got[10 + s][0] - want[0]) < 1e-9 and tuple(got[10 + s][1]) == want[1]


def test_path_fallbacks(spark):
    """Line 0-1-2 with a long way round; no path has thirty songs."""
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 0.0)], "src long, dst long, score double")
    profiles = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [0.5])], "id long, scores array<double>")
    starts = spark.createDataFrame([(1, 0, [1.0]), (2, 2, [1.0])], "request_id long, start long, target array<double>")
    closest = {r["request_id"]: r["path"] for r in G.mood_path(edges, profiles, starts).collect()}
    assert closest == {1: [0, 1], 2: [2]}
    last = {r["request_id"]: (round(r["cost"], 6), r["path"]) for r in G.mood_path(edges, profiles, starts, fallback="reference").collect()}
    assert last == {1: (1.2, [0, 2]), 2: (0.0, [2])}


@pytest.mark.parametrize("bucket", [0.05, 10.0])
def test_paths_do_not_depend_on_the_bucket(spark, bucket):
    """A ring with shortcuts: long paths, many rounds, and requests that stop early next to some that never reach full length."""
    rng = random.Random(5)
    edges = [(i, (i + 1) % 30, 0.9) for i in range(30)] + [(i, (i + 7) % 30, round(rng.random() * 0.3, 3)) for i in range(0, 30, 3)] + [(40, 41, 0.5)]
    moods = {i: [rng.random(), rng.random()] for i in [*range(30), 40, 41]}
    links = {}
    for u, v, s in edges:
        links.setdefault(u, []).append((v, (1 - s) + 0.4 * math.dist(moods[v], [1.0, 0.0])))
    starts = spark.createDataFrame([(i, i, [1.0, 0.0]) for i in (0, 4, 11, 40)], "request_id long, start long, target array<double>")
    edge_df = spark.createDataFrame(edges, "src long, dst long, score double")
    profile_df = spark.createDataFrame(list(moods.items()), "id long, scores array<double>")
    got = {r["request_id"]: (r["cost"], tuple(r["path"])) for r in G.mood_path(edge_df, profile_df, starts, 6, bucket=bucket).collect()}
    for s in (0, 4, 11):
        best = shortest(links, s, 6)
        want = min(b for b in best.values() if len(b[1]) == 6)
        assert abs(got[s][0] - want[0]) < 1e-9 and got[s][1] == want[1]
    assert got[40][1] in {(40,), (40, 41)}


def test_score_above_one_never_lowers_the_cost(spark):
    edges = spark.createDataFrame([(0, 1, 1.0000001), (1, 0, 1.0)], "src long, dst long, score double")
    profiles = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "id long, scores array<double>")
    starts = spark.createDataFrame([(1, 0, [1.0])], "request_id long, start long, target array<double>")
    assert G.mood_path(edges, profiles, starts, max_steps=2).first()["cost"] == 0.0


@pytest.mark.parametrize("steps", [4, 30])
def test_paths_in_tasks_equal_those_by_joins(spark, monkeypatch, steps):
    """Ties, songs listed twice, songs and starts without moods, and links to unknown songs; no label leaves a task."""
    rng = random.Random(8)
    edges = [(u, v, rng.choice([0.2, 0.5, 0.9])) for u in range(40) for v in rng.sample(range(44), 3) if u != v]
    profiles = [(i, [rng.choice([0.0, 0.5, 1.0]), rng.random()]) for i in range(40) if i != 7] + [(3, [0.0, 0.0])]
    starts = spark.createDataFrame([(100 + i, i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in [*range(40), 60]], "request_id long, start long, target array<double>")
    args = spark.createDataFrame(edges, "src long, dst long, score double"), spark.createDataFrame(profiles, "id long, scores array<double>"), starts

    def both():
        costs = {(r["request_id"], r["node"]): round(r["cost"], 9) for r in G.mood_path_costs(*args, 3).collect()}
        return costs, {r["request_id"]: (round(r["cost"], 9), r["path"]) for r in G.mood_path(*args, steps).collect()}

    monkeypatch.setattr(G.held_paths, "HELD_LINKS", 0)
    joined = both()
    monkeypatch.undo()
    written = []
    monkeypatch.setattr(G, "store", lambda df, name: written.append(name) or df)
    assert both() == joined
    assert "labels" not in written and "path-costs" not in written
