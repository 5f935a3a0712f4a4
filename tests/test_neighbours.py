"""Exact neighbours against brute force under skew, copies and small chunks."""

import numpy as np
import pytest

from arcloom.operators.neighbours import knn_l2


def brute(ids, x, k):
    d = np.round(np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(-1)), 6)
    ids = np.array(ids)
    out = {}
    for i, me in enumerate(ids):
        order = [j for j in np.lexsort((ids, d[i])) if j != i][:k]
        out[me] = [(ids[j], round(float(d[i, j]), 6)) for j in order]
    return out


def frame(spark, ids, x):
    kind = "string" if isinstance(ids[0], str) else "long"
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], f"id {kind}, embedding array<double>")


def got(df):
    out = {}
    for r in df.orderBy("src", "rank").collect():
        out.setdefault(r["src"], []).append((r["dst"], round(r["dist"], 6)))
    return out


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 20, "chunk_rows": 7}, {"cell_rows": 60, "chunk_rows": 200}])
def test_clustered_vectors(spark, sizes):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.2, (60, 5)) for c in (-3, 0, 3)])
    ids = [int(i) for i in rng.permutation(len(x))]
    assert got(knn_l2(frame(spark, ids, x), 6, **sizes)) == brute(ids, x, 6)


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 15, "chunk_rows": 9}])
def test_a_third_of_the_rows_are_copies(spark, sizes):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (150, 4))
    x[::3] = x[0]
    x[1::7] = x[1]
    ids = [f"s{i:03d}" for i in range(len(x))]
    assert got(knn_l2(frame(spark, ids, x), 4, **sizes)) == brute(ids, x, 4)


def test_ties_on_a_grid_go_to_the_lower_id(spark):
    x = np.array([[a, b] for a in range(8) for b in range(8)], dtype=float)
    ids = list(range(64))
    assert got(knn_l2(frame(spark, ids, x), 5, cell_rows=10, chunk_rows=5)) == brute(ids, x, 5)


def test_far_from_the_origin(spark):
    rng = np.random.default_rng(5)
    x = 1000 + rng.normal(0, 0.01, (80, 3))
    ids = list(range(80))
    assert got(knn_l2(frame(spark, ids, x), 5, cell_rows=25, chunk_rows=10)) == brute(ids, x, 5)


def test_fewer_songs_than_neighbours(spark):
    x = np.array([[0.0], [1.0], [5.0]])
    out = got(knn_l2(frame(spark, [1, 2, 3], x), 10))
    assert out == brute([1, 2, 3], x, 10)
    assert got(knn_l2(frame(spark, [1], x[:1]), 10)) == {}


def test_cosine_comes_with_the_neighbours(spark):
    x = np.array([[1.0, 0.0], [2.0, 0.0], [0.0, 3.0], [0.0, 0.0]])
    rows = {(r["src"], r["dst"]): r["cosine"] for r in knn_l2(frame(spark, [0, 1, 2, 3], x), 3).collect()}
    assert abs(rows[0, 1] - 1) < 1e-6 and abs(rows[0, 2]) < 1e-9 and rows[0, 3] == 0


def test_a_query_leaves_with_one_list_however_many_blocks_it_met(spark):
    """What the search shuffles grows with the rows, not with their number of blocks."""
    from arcloom.operators import block_search as B

    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 4))
    songs = frame(spark, list(range(300)), x).repartition(4)
    queries = B.pack(songs.selectExpr("CAST(id % 2 AS int) AS key", "id", "0 AS cell", "embedding"))
    blocks = B.pack(songs.selectExpr("0 AS key", "id", "0 AS cell", "embedding"), 7)
    rows = B.deal(queries, blocks, 2, 1, 6).collect()
    want = brute(list(range(300)), x, 5)
    assert blocks.count() > 40 and len(rows) == 300 * 6
    assert {(r["rep"], r["id"], round(r["dist"], 6)) for r in rows if r["rep"] != r["id"]} == {(i, *n) for i, near in want.items() for n in near}


def test_a_vector_goes_to_as_many_tasks_in_a_larger_table(spark):
    """The copies of a vector that the search sends out follow the cores, not the rows, and queries are not repeated."""
    from arcloom.operators import block_search as B

    tasks = 4 * spark.sparkContext.defaultParallelism
    least, most = tasks * B.LEAST_ROWS, tasks * B.QUERY_ROWS
    assert {B.group_counts(spark, n, n) for n in (least, 6 * least, most // 2, most)} == {(tasks, 1)}
    assert B.group_counts(spark, 2 * most, 2 * most) == (2 * tasks, 1)
