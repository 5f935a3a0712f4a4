"""A queue that is worked off in committed batches, stopped half-way and resumed."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcloom.operators import enrichment as E

RESULT = T.StructType([T.StructField("size", T.LongType()), T.StructField("note", T.StringType())])
SCHEMA = "ord long, id long, name string, note string, processed_at timestamp, extraction_error string"


def songs(spark, n=60):
    rows = [(i, i, None if i % 7 == 0 else f"song {i}", "old", None, None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def worker(folder, stop=None):
    """Counts calls per id in files; fails for rows without a name; ends the task at ``stop`` as a lost worker does."""

    def work(row):
        if stop is not None and row["id"] == stop:
            raise SystemExit(1)
        with open(os.path.join(folder, str(row["id"])), "a") as f:
            f.write("x")
        if row["name"] is None:
            raise KeyError("no name")
        return {"size": len(row["name"])}

    return work


def run(df, folder, work, **sizes):
    return E.enrich_pending(df, "ord", str(folder), "id", work, RESULT, F.to_timestamp(F.lit("2024-06-01")), **{"files": 12, "files_per_commit": 1, **sizes})


def test_stopped_half_way_and_resumed(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    df = songs(spark)
    E.enqueue(songs(spark, 30), str(tmp_path / "work"), "id", "ord", 3)  # older files are read first
    with pytest.raises(StreamingQueryException):
        run(df, tmp_path / "work", worker(str(calls), stop=31))
    committed = {r["id"] for r in spark.read.parquet(str(tmp_path / "work/results")).collect()}
    before = set(os.listdir(calls))
    assert committed >= set(range(30)) and 31 not in committed
    out = {r["id"]: r for r in run(df, tmp_path / "work", worker(str(calls))).collect()}
    times = {int(name): len((calls / name).read_text()) for name in os.listdir(calls)}
    assert set(times) == set(range(60)) and all(times[i] == 1 for i in committed)
    assert all(times[i] == 1 or (i in map(int, before) and i not in committed) for i in times)
    for i, r in out.items():
        if i % 7 == 0:
            assert (r["size"], r["processed_at"], r["extraction_error"]) == (None, None, "KeyError: 'no name'")
        else:
            assert r["size"] == len(f"song {i}") and r["processed_at"] is not None and r["extraction_error"] is None
        assert r["note"] == "old"


def test_later_songs_join_the_queue_and_nothing_is_done_twice(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    work = worker(str(calls))
    first = run(songs(spark, 10), tmp_path / "work", work, files=3)
    assert first.filter("processed_at is null and extraction_error is null").count() == 0
    again = run(songs(spark, 15), tmp_path / "work", work, files=3)
    assert again.filter("size is not null").count() == 12
    assert {int(n): len((calls / n).read_text()) for n in os.listdir(calls)} == {i: 1 for i in range(15)}


def test_cases(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [(1, 5, "a", "n", None, None), (2, 5, "bbb", "n", None, None), (3, None, "c", "n", None, None), (4, 6, "dd", "n", None, "seen before"),
            (5, 7, "x" * 100_000, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["ord"]: r for r in run(df, tmp_path / "work", worker(str(calls))).collect()}
    assert (out[1]["size"], out[2]["size"]) == (1, 1) and sorted(os.listdir(calls)) == ["5", "7"]
    assert out[3]["processed_at"] is None and out[3]["extraction_error"] is None
    assert (out[4]["size"], out[4]["extraction_error"]) == (None, "seen before") and out[5]["size"] == 100_000
    empty = run(spark.createDataFrame([], SCHEMA), tmp_path / "none", worker(str(calls)))
    assert empty.count() == 0 and empty.columns == ["ord", "id", "name", "processed_at", "extraction_error", "size", "note"]
