"""Winnowing against plain Python over all windows, and the guarantee of the fingerprints."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcloom.llm.decontaminate import clean_rows, contamination, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, length=10):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(length, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def check(spark, docs, items):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = contamination(d, b).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=str) == brute(docs, items)
    for r in got:
        assert len({w for s in r["spans"] for w in range(s["begin"], s["stop"])}) == r["n_hit"]


def words(a, b, tail=""):
    return " ".join(f"w{i}" for i in range(a, b)) + tail


def test_windows_short_items_nulls_and_repeats(spark):
    items = [(1, words(0, 10)), (2, words(5, 40)), (11, "Tiny item"), (3, "one"), (4, None), (5, " ,. "), (6, words(5, 40)), (7, "a a a a a a a a a a a a a a a")]
    docs = [(1, "x " + words(0, 10) + " y"), (2, words(0, 9)), (3, "the TINY, item! tiny"), (4, "oNe of one"), (5, None), (6, ""), (7, words(30, 45)),
            (8, words(31, 45)), (9, "a " * 40), (10, words(0, 40) * 200), (1, "x " + words(0, 10) + " y"), (None, words(0, 12)), (12, "W0 w1-w2 w3.w4 w5 w6 w7 w8 w9é")]
    check(spark, docs, items)


def test_no_items_or_no_documents(spark):
    check(spark, [(1, words(0, 30))], [(1, None)])
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([(1, words(0, 30))], "item_id long, text string")
    assert contamination(d, b).count() == 0
    assert contamination(b.withColumnRenamed("item_id", "doc_id"), b.filter(F.lit(False))).first()["n_hit"] == 0


def test_clean_rows(spark):
    docs = spark.createDataFrame([(1, words(0, 30), 5), (1, "clean", 5), (None, words(3, 14), 6), (2, None, 7)], "doc_id long, text string, found int")
    items = spark.createDataFrame([(1, words(0, 30))], "item_id long, text string")
    out = clean_rows(docs, items)
    assert out.columns == docs.columns and sorted((r[1], r[2]) for r in out.collect() if r[1]) == [("clean", 5)] and out.count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=0, max_size=30), st.lists(st.integers(0, 5), min_size=0, max_size=30), st.integers(1, 10))
def test_shared_spans_share_a_fingerprint(a, b, length):
    def prints(x):
        h = np.array([v * 7919 + 13 for v in x], np.uint64)
        pos, fp = winnow(h, np.array([0, len(h)]), length)
        return dict(zip(pos.tolist(), fp.tolist()))

    pa_, pb = prints(a), prints(b)
    for i in range(len(a) - length + 1):
        for j in range(len(b) - length + 1):
            if a[i : i + length] == b[j : j + length]:
                assert any(p + j - i in pb and pb[p + j - i] == f for p, f in pa_.items() if i <= p < i + length)
