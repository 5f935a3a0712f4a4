"""The near-duplicate stage of the pipeline against all pairs at five words and a similarity of 0.8."""

import corpus_pipeline
from tests.llm.test_substring_dedup import LOWER, SPACE


def shingles(text):
    words = (text or "").translate(LOWER).translate({ord(c): " " for c in SPACE}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """The smallest id of each component."""
    sets, top = [(d, shingles(t)) for d, t in rows], {d: d for d, _ in rows}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((root(d), root(e)))
                top[b] = a
    return {d for d, _ in rows if root(d) == d}


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}


def test_band_between_the_contracts(spark):
    words = [f"word{i}" for i in range(200)]

    def changed(*at):
        return " ".join("new" + w if i in at else w for i, w in enumerate(words))

    # 200 words have 196 shingles of five words; four changes leave 176 of 216 (0.815), of four words 181 of 213 (0.8498).
    rows = [(1, changed()), (2, changed(20, 60, 100, 140)), (3, changed(20, 60, 100, 140, 180, 190, 30)), (4, "some other words that stand alone here"), (5, None)]
    rows += [(6, " ".join(words[:100]) + " " + " ".join(f"far{i}" for i in range(100)))]
    # 355 of 437 (0.812) at five words, 364 of 430 (0.847) at four.
    many = [f"item{i}" for i in range(400)]
    rows += [(10, " ".join(many)), (11, " ".join("x" + w if i in {30 * j + 20 for j in range(8)} | {399} else w for i, w in enumerate(many)))]
    want = kept(rows)
    assert stage(spark, rows) == want and not {2, 11} & want and {1, 4, 5, 6, 10} <= want


def test_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert stage(spark, rows) == kept(rows)
