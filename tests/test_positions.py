"""Positions, running totals and sampling."""

import random

from pyspark.sql import functions as F

from arcloom.functions.hashing import uniform
from arcloom.operators import catalogue as C
from arcloom.operators.positions import hash_positions, running_total, with_positions


def test_positions_are_dense_per_group_even_if_one_group_is_hot(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50))
    rows = hash_positions(df, "s", ["id"], groups=["g"]).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r["g"], []).append((r["pos"], r["pos_n"]))
    for group in seen.values():
        assert sorted(p for p, _ in group) == list(range(len(group)))
        assert {n for _, n in group} == {len(group)}
    assert len(rows) == 3000


def test_positions_do_not_depend_on_partitioning(spark):
    df = spark.range(500)
    a = {r["id"]: r["pos"] for r in hash_positions(df.repartition(1), "s", ["id"]).collect()}
    b = {r["id"]: r["pos"] for r in hash_positions(df.repartition(13), "s", ["id"]).collect()}
    assert a == b


def test_quota_keeps_exactly_the_first_rows(spark):
    df = spark.range(5000)
    full = {r["id"] for r in hash_positions(df, "q", ["id"]).filter("pos < 77").collect()}
    cut = {r["id"] for r in hash_positions(df, "q", ["id"], quota=F.lit(77)).collect()}
    assert full == cut and len(cut) == 77


def test_positions_by_number(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("id"))
    rows = with_positions(df, bucket=F.floor(F.col("id") / 100), order=["id"]).collect()
    assert all(r["pos"] == r["id"] // 7 for r in rows)


def test_running_total(spark):
    rng = random.Random(1)
    values = {round(rng.random() ** 4, 6): rng.randint(0, 9) for _ in range(700)}
    df = spark.createDataFrame(list(values.items()), "x double, v long")
    got = {r["x"]: r["v_before"] for r in running_total(df, "x", ["v"], slices=16).collect()}
    total = 0
    for x in sorted(values):
        assert got[x] == total
        total += values[x]


def test_uniform_is_uniform(spark):
    stats = spark.range(20000).agg(F.avg(uniform("u", "id")), F.stddev(uniform("u", "id"))).first()
    assert abs(stats[0] - 0.5) < 0.01 and abs(stats[1] - (1 / 12) ** 0.5) < 0.01


def _genres(spark, sizes):
    rows = [(i, g) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "id long, genre string")


def test_stratified_sample_quota_and_null_genre(spark):
    df = _genres(spark, {"a": 50, "b": 3, "c": 20, None: 10})
    counts = {r["genre"]: r["count"] for r in C.stratified_sample(df, "genre", 30, "s", ["id"]).groupBy("genre").count().collect()}
    assert counts == {"a": 10, "b": 3, "c": 10}


def test_small_catalogue_is_kept_whole(spark):
    df = _genres(spark, {"a": 5, None: 2})
    assert C.stratified_sample(df, "genre", 30, "s", ["id"]).count() == 7


def test_topup_fills_to_size_without_repeats(spark):
    df = _genres(spark, {"a": 50, "b": 3, "c": 20, None: 10})
    drawn = C.stratified_sample(df, "genre", 40, "s", ["id"])
    ids = [r["id"] for r in C.sample_topup(df, drawn, 40, "t", ["id"]).collect()]
    assert len(ids) == len(set(ids)) == 40
    assert {r["id"] for r in drawn.collect()} <= set(ids)


def test_more_genres_than_rows_wanted(spark):
    df = _genres(spark, {f"g{i}": 4 for i in range(30)})
    drawn = C.stratified_sample(df, "genre", 10, "s", ["id"])
    assert drawn.count() == 30
    assert C.sample_topup(df, drawn, 10, "t", ["id"]).count() == 10


def test_split_has_floor_counts(spark):
    counts = {r["split"]: r["count"] for r in C.train_val_test_split(spark.range(1237), "s", ["id"]).groupBy("split").count().collect()}
    assert counts == {"train": 989, "val": 123, "test": 125}


def test_clean_trim_and_language(spark):
    rows = [(" a1 ", "n", "x", None, None, " K-Pop "), ("\t ", "n", "x", None, None, "rock"), ("b", None, "x", "al", 5, None),
            ("c", "m\n", " y", "al", 7, "SALSA")]
    df = spark.createDataFrame(rows, "track_id string, track_name string, artists string, album_name string, duration_ms long, track_genre string")
    out = {r["id"]: r for r in C.project_catalog(C.clean_catalog(df)).collect()}
    assert set(out) == {"a1", "c"}
    assert (out["a1"]["album"], out["a1"]["duration_ms"], out["c"]["name"], out["c"]["artist"]) == ("", 0, "m", "y")
    langs = [r[0] for r in df.select(C.infer_language("track_genre")).collect()]
    assert langs == ["ko", "en", "en", "es"]


def test_errors_are_cut(spark):
    df = spark.createDataFrame([("E" * 400, "m" * 300), (None, None)], "error_type string, error_message string")
    whole = [r[0] for r in C.capture_errors(df).collect()]
    assert whole == ["E" * 400 + ": " + "m" * 300, None]
    got = [r[0] for r in C.capture_errors(df, 200, 500).collect()]
    assert len(got[0]) == 500 and got[1] is None


def test_batches_of_track_ids(spark):
    rows = [(1, i, f"t{i}" if i % 10 else "bad id") for i in range(250)]
    df = spark.createDataFrame(rows, "request_id long, pos long, id string")
    out = C.split_track_ids(df).collect()
    good = [r for r in out if r["valid"]]
    assert len(good) == 225 and sorted({r["batch_no"] for r in good}) == [0, 1, 2]
    assert all(r["uri"] is None and r["batch_no"] is None for r in out if not r["valid"])
