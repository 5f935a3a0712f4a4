"""Base statistics against plain Python; the estimates against numpy; verdicts on planted outliers."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    count = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeat = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a a a", "a a a a", "a b c a b c", "x\n\ny\nx\n x\n\n", "# * $%&|<> é\U0001f600", "a\x0bb\x0cc\rd e\x1ff",
         "w " * 20_000, " ".join(map(str, range(20_000))), "same line\n" * 60, " ".join(f"u{i}" for i in range(60)) + " u1 u2 u3", "a b c d e a b c f c a b c"]


def test_base_statistics(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: tuple(r[c] for c in Q.BASE) for r in Q.base_statistics(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def prose(rng, n, junk=0.0):
    return " ".join(("#*%" if rng.random() < junk else "") + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(60, 900)), "en", "s") for i in range(220)]
    rows += [(1000 + i, prose(rng, rng.randrange(60, 900), junk=0.5), "en", "s") for i in range(50)]
    rows += [(2000 + i, prose(rng, 80), None, None) for i in range(3)] + [(3000, None, "en", None), (3001, "few words", "en", "s"), (0, rows[0][1], "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    stats = Q.store(Q.base_statistics(docs).drop("text"), "test-statistics")
    return Q.judge(stats).collect()


def test_outliers_go_and_the_rest_stays(judged):
    assert len(judged) == 276
    for r in judged:
        assert r["kept"] == (r["doc_id"] < 1000 or 2000 <= r["doc_id"] < 3000), r
        assert (r["distance"] is None) == r["base_failed"]


def test_distance_equals_numpy(spark):
    """Concentration steps over sorted bins, on the same whole numbers."""
    rng = np.random.default_rng(2)
    x = (rng.multivariate_normal(np.zeros(Q.P), np.eye(Q.P) * 0.3 + 0.1, 400) * Q.SCALE).round()
    x[:60] += 6 * Q.SCALE
    frame = spark.createDataFrame([("en", "s", *map(int, v)) for v in x], "lang string, source string, " + ", ".join(f"{c} long" for c in Q.X))
    est = Q.robust_estimates(Q.store(frame, "test-vectors")).first()
    floor = np.diag((np.array(Q.LEAST_SPREAD) * Q.SCALE) ** 2)

    def estimate(rows):
        m = rows.mean(0)
        cov = (rows.T @ rows / len(rows) - np.outer(m, m)) * Q.consistency(Q.COVERAGE, Q.P) + floor
        return m, np.linalg.inv(np.linalg.cholesky(cov)), np.log(np.diag(np.linalg.cholesky(cov))).sum()

    med = np.median(x, 0)
    mad = 1.4826 * np.median(abs(x - med), 0)
    starts = [(med, np.diag(1 / np.sqrt(mad**2 + np.diag(floor))), 0.0), estimate(x)]
    for _ in range(Q.STEPS):
        after = []
        for m, k, _ in starts:
            d2 = (((x - m) @ k.T) ** 2).sum(1)
            bins = np.floor(Q.BINS * np.log(d2 + 1e-6))
            order = np.sort(bins)
            after.append(estimate(x[bins <= order[int(np.ceil(Q.COVERAGE * len(x))) - 1]]))
        starts = after
    m, k, det = min(starts, key=lambda s: s[2])
    assert np.allclose([est[f"m{i}"] for i in range(Q.P)], m) and np.isclose(est["det"], det)
    assert np.allclose([est[f"k{i}{j}"] for i, j in Q.PAIRS], [k[i, j] for i, j in Q.PAIRS])


def test_consistency_factor():
    assert abs(Q.chi_square_share(5.991, 2) - 0.95) < 1e-4 and abs(Q.consistency(0.999999, 5) - 1) < 1e-3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.judge(Q.store(Q.base_statistics(docs), "test-empty")).count() == 0
    assert Q.judge(Q.store(Q.base_statistics(docs.union(spark.createDataFrame([(1, None, None, None)], docs.schema))), "test-one")).filter(~F.col("kept")).count() == 1
