"""Components of near duplicates against all pairs in plain Python."""

import random
import re

from pyspark.sql import functions as F

from arcloom.llm.components import components
from arcloom.llm.ngram_join import ngram_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [(d, grams(t)) for d, t in rows]
    top = {i: i for i in range(len(rows))}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i][1], sets[j][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, (d, s) in enumerate(sets)), key=str)


def check(spark, rows, parts=5, **options):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, size string").repartition(parts)
    got = ngram_components(docs, **options).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_groups_chains_and_noise(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(40):
        chain = chain[2:] + [rng.choice(vocabulary) for _ in range(2)]
        rows.append((1000 - i, " ".join(chain)))
    rows += [(2000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) + " " + " ".join(base[:30])) for i in range(40)]
    check(spark, rows)
    check(spark, rows, parts=2, sketch_bits=4)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A  b\tc"), (6, "a b c d"), (7, "a b c d e"), (8, "one"), (9, "one"), (10, "One two"),
            (11, "w " * 500), (12, "w w w w"), (8, "one"), (20, " ".join(map(str, range(40_000)))), (21, " ".join(map(str, range(40_100)))), (22, "é è"), (23, "é è")]
    check(spark, rows)


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "only here"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(docs).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (None, 1, None), (None, 0, None)], key=str)
    assert ngram_components(docs.filter(F.lit(False))).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(5, i) for i in range(1000, 1300)] + [(7, 7), (8, 9), (9, 8)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 401)) and all(got[i] == 5 for i in range(1000, 1300)) and got[8] == got[9] == 8
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
