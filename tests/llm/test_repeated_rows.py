"""Rows with equal doc_id and text are one document for span removal."""

import numpy as np
import pyarrow as pa

from arcloom.llm.substring_dedup import _repeats, remove_repeats

TEXT = "one two three four five six seven eight nine ten. eleven twelve thirteen fourteen fifteen sixteen seventeen."


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r["doc_id"], r["text"], r["n_removed"] > 0) for r in remove_repeats(docs).collect()), key=str)


def test_repeated_rows_keep_their_text(spark):
    other = TEXT.replace("e", "u")
    assert result(spark, [(1, TEXT), (1, TEXT), (1, TEXT)]) == [(1, TEXT, False)] * 3
    assert result(spark, [(None, TEXT), (None, TEXT)]) == [(None, TEXT, False)] * 2
    assert result(spark, [(1, TEXT), (1, TEXT), (1, other), (2, TEXT), (2, TEXT)]) == [(1, TEXT, False)] * 2 + [(1, other, False)] + [(2, "", True)] * 2


def test_rows_of_one_place_over_batches():
    draw = np.random.Generator(np.random.PCG64(5))
    for size in (1, 2, 3, 7, 60):
        places = sorted((int(h), int(d), int(t), int(b)) for h, d, t, b in draw.integers(0, 3, (60, 4)))
        columns = [pa.array([p[0] for p in places]), pa.array([p[1] or None for p in places], pa.int64()), *[pa.array([p[j] for p in places]) for j in (2, 3, 3)]]
        whole = pa.RecordBatch.from_arrays(columns, ["hash", "doc", "text_hash", "begin", "stop"])
        out = pa.Table.from_batches(list(_repeats(whole.slice(lo, size) for lo in range(0, 60, size)))).to_pylist()
        first = {}
        for p in places:
            first.setdefault(p[0], p)
        want = [p for p in places if p != first[p[0]]]
        assert [(r["hash"], r["doc"] or 0, r["text_hash"], r["begin"]) for r in out if r["kind"] == "repeat"] == want
        assert [r["kind"] for r in out if r["kind"] != "repeat"] == ["open", "end"]
