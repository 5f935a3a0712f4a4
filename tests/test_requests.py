"""Requests end to end: seeds in stages, errors, playlists with names."""

import pytest

from arcloom.operators import graphs as G
from arcloom.operators import playlist as P
from arcloom.operators.moods import mood_pools, pool_sizes
from arcloom.operators.requests import resolve_requests, serve
from arcloom.sources.workspace import store


@pytest.fixture(scope="module")
def library(spark):
    rows = [(i, f"Song {'red' if i % 2 else 'blue'} {i}", "Anna" if i < 20 else "Bert", [float(i % 2) + i * 0.01, 1.0 + i * 0.001], "en",
             [0.8, 0.2] if i % 2 == 0 else [0.2, 0.8], [0, 1]) for i in range(40)]
    songs = spark.createDataFrame(rows, "id long, name string, artist string, embedding array<double>, language string, scores array<double>, mood_ids array<int>")
    labels = spark.createDataFrame([(0, "calm"), (1, "loud")], "label_id int, label string")
    pools = store(mood_pools(songs.select("id", "embedding", "language", "scores", "mood_ids")), "pools")
    near = P.neighbour_table(G.scored_neighbours(songs.select("id", "embedding"), P.NEAREST_KEPT), songs)
    return songs, labels, pools, pool_sizes(pools), near


REQUESTS = "request_id long, seed_id long, seed_query string, arc array<string>, temperature double, playlist_len int, wanted string"


def test_seeds_in_stages(spark, library):
    songs, _, pools, sizes, _ = library
    rows = [(1, 7, "red", [0]), (2, 99, "red", [0]), (3, None, "Song red 3", [0]), (4, None, "qqxx", [0]), (5, None, "  ", [1]), (6, None, None, [0]), (7, None, "bert", [0])]
    asked = spark.createDataFrame([(*r, None) for r in rows], "request_id long, seed_id long, seed_query string, arc array<int>, wanted string")
    got = {r["request_id"]: (r["id"], r["stage"], r["resolved"]) for r in resolve_requests(asked, songs, pools, sizes).collect()}
    assert got[1] == (7, "id", True) and got[2] == (None, "id", False) and got[3] == (3, "text", True) and got[4] == (None, "text", False)
    assert got[5][1:] == ("random", True) and got[5][0] % 2 == 1 and got[6][1:] == ("random", True) and got[6][0] % 2 == 0
    assert got[7] == (20, "text", True) and len(got) == 7


def test_serve(spark, library):
    songs, labels, pools, sizes, near = library
    rows = [(1, 4, None, ["calm", "loud"], 0.3, 6, None), (2, 99, None, ["calm"], 0.3, 6, None), (3, None, None, [], 0.3, 6, None),
            (4, None, "anna", ["loud", "what"], 0.3, 6, None), (5, None, "bert", ["loud"], 0.3, 5, None)]
    playlists, outcome = serve(spark.createDataFrame(rows, REQUESTS), songs, songs, labels, near, pools, sizes)
    told = {r["request_id"]: r for r in outcome.collect()}
    assert told[1]["errors"] == [] and told[1]["n_songs"] == 7 and told[1]["seed"] == 4 and told[5]["n_songs"] == 6 and told[5]["seed"] == 20
    assert told[2]["errors"] == ["seed not found"] and told[3]["errors"] == ["empty arc"] and told[4]["errors"] == ["unknown moods: what"]
    assert all(told[i]["n_songs"] == 0 for i in (2, 3, 4))
    names = {r["id"]: (r["name"], r["artist"]) for r in songs.collect()}
    out = playlists.collect()
    assert {r["request_id"] for r in out} == {1, 5}
    for r in out:
        assert (r["name"], r["artist"]) == names[r["id"]] and r["top_mood"] == ("loud" if r["id"] % 2 else "calm") == max(r["moods"], key=r["moods"].get)


def test_no_requests(spark, library):
    songs, labels, pools, sizes, near = library
    playlists, outcome = serve(spark.createDataFrame([], REQUESTS), songs, songs, labels, near, pools, sizes)
    assert playlists.count() == 0 and outcome.count() == 0
