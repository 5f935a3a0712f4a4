"""Learned rank index and fill-in-the-middle against a plain regular expression."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.llm.fill_middle import boundaries, cut_at, fill_in_middle, fit, rank_index, restore

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "\n\t ", "one", "  one two\x0b", "日本語 の 文。 x ", "a" * 5000, ("b" * 900 + " ") * 40, "x y " * 3000, "has <P> in it", "ends <", "<S", "P> <<P"]
TEXTS += [" ".join("w" * (1 + i * i % 37) for i in range(2500)), ("a b c d e f g h " * 300 + "long" * 400 + " ") * 4]


def places_of(text):
    return [0, *(m.end() for m in UNIT.finditer(text or ""))]


def brute(doc, text, seed=42, fim=50, spm=80):
    text = text or ""
    at = places_of(text)
    n = len(at) - 1
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[: at[a]], text[at[a] : at[b]], text[at[b] :]
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("error", [0, 3, 127])
def test_every_rank_is_exact(spark, error):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    rows = rank_index(docs, error)
    ranks = F.explode(F.sequence(F.lit(0), F.col("index.n")))
    found = {}
    for r in rows.select("doc_id", "index", ranks.alias("r")).select("doc_id", "r", cut_at(F.col("index"), F.col("r")).alias("at")).collect():
        found.setdefault(r["doc_id"], {})[r["r"]] = r["at"]
    for i, text in enumerate(TEXTS):
        want = places_of(text)
        assert [found[i][r] for r in range(len(want))] == want
    for r in rows.select("index.*").collect():
        assert len(r["residuals"]) == r["n"] + 1 and max(abs(b - 256 if b > 127 else b) for b in r["residuals"]) <= error


def test_few_pieces_where_units_are_alike():
    text = ("word " * 4000).encode()
    places, begin = boundaries(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    ends, residuals = fit(places, begin, 8)
    assert len(ends) <= 16 and abs(residuals).max() <= 8 and len(places) == 4002


@pytest.mark.parametrize("seed,fim,spm", [(42, 50, 80), (7, 100, 50), (8, 100, 0), (9, 0, 50)])
def test_equals_brute_force_and_comes_back(spark, seed, fim, spm):
    rows = [(d if d % 11 else None, t) for d, t in enumerate(TEXTS * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = fill_in_middle(docs, seed, fim, spm)
    got = out.select("*", restore(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted(
        ((d, *brute(d, t, seed, fim, spm)) for d, t in rows), key=key)
    assert all(r["back"] == (r["text"] or "") for r in got)


def test_stored_index_other_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 5), (1, "a b c d e f", "x", 5), (2, None, "y", 6)], "doc_id long, text string, form string, source int")
    once = fill_in_middle(docs, 3, 100)
    index = rank_index(docs)
    assert sorted(map(str, fill_in_middle(index, 3, 100).collect())) == sorted(map(str, once.collect()))
    assert once.count() == 3 and set(once.columns) == {"doc_id", "text", "source", "n", "form", "prefix_chars", "middle_chars", "output"}
    assert {r["form"] for r in once.collect()} <= {"psm", "spm", "plain"}
    assert fill_in_middle(docs.limit(0)).count() == 0
