"""Importance resampling against plain Python with dictionaries and a full sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.llm import importance
from arcloom.llm.importance import KEY, bucket_counts, cutoff, feature_crcs, gains, keyed, ranked, resample
from arcloom.sources.workspace import store

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, percent=25, least_words=20, seed=7, buckets=10_000):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t))

    s, t = counts(x for _, x in docs), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s_all + buckets) / ((s[k] + 1) * (t_all + buckets)))) for k in range(buckets)]
    rows = []
    for d, x in docs:
        f = features(x)
        weight = sum(gain[zlib.crc32(i.encode()) % buckets] for i in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if (r[1] + 1) // 2 >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = [(*r, i + 1) for i, r in enumerate(able[: percent * len(able) // 100])]
    left = Counter(rows) - Counter(r[:4] for r in drawn)
    return sorted([*drawn, *((*r, None) for r in left.elements())], key=str)


def check(spark, docs, target, **options):
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(map(tuple, resample(table, aim, **options).collect()), key=str)
    assert got == brute(docs, target, **options)
    return got


def test_crcs_of_words_and_pairs():
    draw = random.Random(3)
    words = ["".join(draw.choice("abCé日1") for _ in range(draw.choice([1, 2, 3, 4, 5, 6, 9, 255, 256, 257, 700]))) for _ in range(400)]
    text = " ".join(words).encode()
    one, two, _ = feature_crcs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    low = [w.translate(LOWER).encode() for w in words]
    assert one.tolist() == [zlib.crc32(w) for w in low] and two.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(low, low[1:])]


def test_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = check(spark, docs, target)
    assert any(r[4] for r in got)
    check(spark, docs, target[:3], percent=60, least_words=1, seed=11, buckets=50)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " ..."), (4, "one"), (5, "Two WORDS"), *[(6, "the same text over and over again")] * 30, (7, "日本 語 x" * 3000), (None, "no id here"), (None, None)]
    for percent in (0, 50, 100):
        check(spark, docs, ["the same words", None, ""], percent=percent, least_words=2)
    check(spark, docs, [], percent=30, least_words=0)
    assert check(spark, docs[:3], ["a"]) == brute(docs[:3], ["a"])


def test_empty_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 3, 4), (2, "d e f", 5, 6)], "doc_id long, text string, rank int, score int")
    aim = spark.createDataFrame([("a b", 1)], "text string, item_id long")
    assert resample(docs.limit(0), aim).count() == 0
    rows = resample(docs, aim, percent=50, least_words=1)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"] and sorted(str(r["rank"]) for r in rows.collect()) == ["1", "None"]


@pytest.mark.parametrize("spread", [2, 1000])
def test_cutoff_is_exact(spark, spread, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 2)
    draw = random.Random(spread)
    rows = [(draw.randrange(spread), draw.choice([None, *range(spread)]), draw.randrange(2), draw.choice([1, 1, 2, 400])) for _ in range(500)]
    rows = sorted({r[:3]: r for r in rows}.values(), key=str)
    table = store(keyed(spark.createDataFrame(rows, "score long, doc_id long, text_hash long, copies long").repartition(6)), "keys")
    order = sorted(((-s, int(d is not None), d or 0, h), c) for s, d, h, c in rows)
    total = sum(c for _, c in order)
    for wanted in (1, total // 3, total):
        left = wanted
        for key, copies in order:
            if left <= copies:
                break
            left -= copies
        assert cutoff(table, wanted) == (key, left)
    assert cutoff(table, 0) is None and cutoff(table, total + 1) is None
    numbers = ranked(table.select("doc_id", "score", *KEY, "copies")).select("rank", "score").collect()
    assert sorted(r["rank"] for r in numbers) == list(range(1, total + 1))
    assert [r["score"] for r in sorted(numbers, key=lambda r: r["rank"])] == [-k[0] for k, c in order for _ in range(c)]


def test_counts_are_whole(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} again") for i in range(400)], "doc_id long, text string").repartition(7)
    counts = bucket_counts(docs.withColumn("x", F.lit(1)), 500)
    want = Counter(zlib.crc32(f.encode()) % 500 for i in range(400) for f in features(f"word{i % 7} again"))
    assert {k: c for k, c in enumerate(counts.tolist()) if c} == want
    assert gains(counts, counts).max() == 0
