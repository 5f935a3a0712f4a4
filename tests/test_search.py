"""Text search and the seed cascade."""

import random

from pyspark.sql import functions as F

from arcloom.operators import search as S

SONGS = [(1, "Blue Moon", "The Cats"), (2, "moonlight", "Ann B"), (3, "Red", "blue sky"), (4, None, "MOON"), (5, "a", "b")]


def songs(spark):
    return spark.createDataFrame(SONGS, "id long, name string, artist string")


def brute(terms):
    out = set()
    for t in terms:
        for i, n, a in SONGS:
            inside = (t in (n or "").lower(), t in (a or "").lower())
            if any(inside):
                out.add((t, i, *inside))
    return out


def test_matches_equal_brute_force(spark):
    words = ["moon", "blue", "b", "an", "e m", "zzz", "moonlight", "red", "_", "%"]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    rows = S.text_matches(songs(spark), terms).collect()
    assert {(r["term"], r["id"], r["in_name"], r["in_artist"]) for r in rows} == brute(words) and len(rows) == len(brute(words))


def test_search_is_limited_per_query_and_ordered_by_id(spark):
    asked = spark.createDataFrame([(7, "MOON"), (8, "moon"), (9, "nothing")], "query_id long, text string")
    profiles = spark.createDataFrame([(1, [0.2, 0.8], [0, 1])], "id long, scores array<double>, mood_ids array<int>")
    rows = S.search_text(asked, songs(spark), profiles, n=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["id"], r["top_mood"]) for r in rows] == [
        (7, 1, 1, 1), (7, 2, 2, None), (8, 1, 1, 1), (8, 2, 2, None)]
    assert rows[0]["profile"] == {0: 0.2, 1: 0.8} and rows[1]["profile"] is None


def test_kept_index_serves_many_searches(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcde é", k=rng.randint(0, 12))) for _ in range(400)]
    rows = [(i, rng.choice([*words, None]), rng.choice([*words, None])) for i in range(600)] + [(700, "same", "same"), (700, "same", "other"), (701, "y" * 50_000 + "abz", None)]
    df = spark.createDataFrame(rows, "id long, name string, artist string")
    index = S.search_index(df, buckets=8)
    for terms in (["abz", "same", "other", "y" * 200], [w[1:1 + k] for k in range(1, 7) for w in words[::9]], ["zzzz", "", None]):
        got = {(r["term"], r["id"]): (r["in_name"], r["in_artist"]) for r in S.text_matches(index, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
        want = {}
        for t in filter(None, terms):
            for i, n, a in rows:
                inside = (t in (n or ""), t in (a or ""))
                if any(inside):
                    old = want.get((t, i), (False, False))
                    want[t, i] = (old[0] or inside[0], old[1] or inside[1])
        assert got == want
    empty = S.search_index(df.limit(0), buckets=8)
    assert S.text_matches(empty, spark.createDataFrame([("a",)], "term string")).count() == 0


def test_seed_cascade(spark):
    asked = spark.createDataFrame(
        [(1, "moon"), (2, "cats"), (3, "xx a sky"), (4, "zz yy"), (5, "nope red blue")], "query_id long, text string")
    rows = {r["query_id"]: (r["id"], r["stage"], r["resolved"]) for r in S.resolve_seed(asked, songs(spark)).collect()}
    assert rows == {1: (1, 1, True), 2: (1, 2, True), 3: (3, 3, True), 4: (None, None, False), 5: (3, 3, True)}
    name_only = {r["query_id"]: r["id"] for r in S.resolve_seed(asked, songs(spark), name_only=True).collect()}
    assert name_only == {1: 1, 2: None, 3: None, 4: None, 5: None}


def test_top_moods_first_label_wins_ties(spark):
    df = spark.createDataFrame([(1, [0.4, 0.4, 0.2], [10, 20, 30])], "id long, scores array<double>, mood_ids array<int>")
    assert [(r["rank"], r["label_id"]) for r in S.top_moods(df, 2).orderBy("rank").collect()] == [(1, 10), (2, 20)]
    assert S.top_moods(df, 3).agg(F.count("*")).first()[0] == 3
