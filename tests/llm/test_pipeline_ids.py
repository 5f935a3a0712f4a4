"""The near-duplicate stage where ids repeat or are null: every clean text stays."""

import corpus_pipeline


def text(word):
    return " ".join(f"{word}{i}" for i in range(120))


def stage(spark, rows, kind="doc_id long, text string, n_chars long"):
    docs = spark.createDataFrame(rows, kind).repartition(4)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(map(tuple, out.collect()), key=str)


def test_ids_that_repeat_with_other_texts(spark):
    a, b, c = text("a"), text("b"), text("c")
    near = b.replace("b60 ", "other ")
    assert stage(spark, [(1, a, 0), (5, a, 0), (5, b, 0), (7, near, 0), (7, c, 0)]) == sorted([(1, a, 0), (5, b, 0), (7, c, 0)], key=str)


def test_null_ids_repeated_rows_and_texts_without_words(spark):
    a, b = text("a"), text("b")
    rows = [(None, a, 1), (3, a, 1), (3, a, 2), (None, b, 1), (None, b, 1), (4, None, 1), (4, None, 1), (5, None, 1), (6, "", 1), (7, "", 1)]
    got = stage(spark, rows)
    assert [(d, t) for d, t, _ in got] == sorted([(3, a), (None, b), (4, None), (5, None), (6, ""), (7, "")], key=str)
    assert stage(spark, rows) == got


def test_clashing_columns_and_empty(spark):
    kind = "doc_id long, text string, node int, component int, place int, doc int, row int, whole int"
    rows = [(1, text("a"), 1, 2, 3, 4, 5, 6), (2, text("a"), 1, 2, 3, 4, 5, 6), (3, text("z"), 1, 2, 3, 4, 5, 6)]
    assert [r[0] for r in stage(spark, rows, kind)] == [1, 3]
    assert stage(spark, [], kind) == []
