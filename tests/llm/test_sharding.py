"""Shards against a plain binary search and walk over all groups."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arcloom.llm.op4 import op4
from arcloom.llm.sharding import shard_rows


def brute(rows, shards):
    """Shard of each text by binary search over the ordered groups."""
    size = defaultdict(int)
    for _, text in rows:
        size[text or ""] += len((text or "").encode()) + 1
    order = sorted(size, key=lambda t: hashlib.sha256(t.encode()).hexdigest())

    def walk(capacity):
        out, shard, room = {}, 0, capacity
        for t in order:
            if size[t] > capacity:
                return None
            if size[t] > room:
                shard, room = shard + 1, capacity
            room -= size[t]
            out[t] = shard
        return out if shard < shards else None

    low, high = 0, sum(size.values())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if walk(mid) is not None else (mid + 1, high)
    return walk(low) or {}


def check(result, rows, shards):
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(text or "")
    want = brute(rows, shards)
    got = result.collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        options = {(len(t.encode()) + 1, zlib.crc32(t.encode()), want[t]) for t in texts[r["doc_id"]]}
        assert (r["size"], r["text_crc32"], r["shard"]) in options
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


@pytest.mark.parametrize("shards", [1, 2, 8])
def test_equals_brute_force(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(shard_rows(docs, shards), rows, shards)


def test_hot_group_ties_nulls_and_repeated_rows(spark):
    rows = [(i, "hot text of many rows") for i in range(2500)] + [(i, f"text {i}" * (i % 50)) for i in range(2500, 2900)]
    rows += [(7, None), (7, None), (None, "x"), (8, ""), (9, "é" * 3000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, shard string").repartition(5)
    check(shard_rows(docs, 8), rows, 8)


def test_fewer_groups_than_shards_and_empty(spark):
    rows = [(1, "a"), (2, "b"), (3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(shard_rows(docs, 8), rows, 8)
    assert shard_rows(docs.filter(F.lit(False))).count() == 0


def test_query(spark):
    out = op4(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    sizes = [r[1] for r in out.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * sum(sizes) / 8
