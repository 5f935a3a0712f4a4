"""Exact k-nearest-neighbour self-join under L2.

1. Equal vectors are collapsed. A query can only meet the ``k + 1`` lowest ids of a vector, so the
   data side keeps just those; members get the result of their representative. However many copies
   a vector has, no task meets them all.
2. Pivots drawn from the distinct vectors cut the space into cells. Dense regions draw more pivots,
   so cells have similar sizes; a cell above ``CHUNK_ROWS`` is further cut by hash.
3. Queries are dealt to groups in the order of their cells and meet the packed cells one after the other, those of
   their own cells first (``block_search``). A block that the triangle inequality rules out is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.hashing import hash_bucket, hash_hex, hex_uniform
from arcloom.operators.block_search import BLOCK_ROWS, DIGITS, SLACK, deal, group_counts, pack
from arcloom.operators.centroids import as_matrix, has_vector
from arcloom.sources.workspace import store

MAX_CELLS = 8192
CELL_ROWS = 32_000
CHUNK_ROWS = 8_000
BLOCK_CELLS = 1_000_000


def squared_distances(q: np.ndarray, d: np.ndarray, d_sq: np.ndarray | None = None) -> np.ndarray:
    """All squared distances by one matrix product, worked on in place."""
    out = (q * -2.0) @ d.T
    out += (d * d).sum(1) if d_sq is None else d_sq
    out += (q * q).sum(1)[:, None]
    return np.maximum(out, 0.0, out=out)


def local_best(q: np.ndarray, d: np.ndarray, d_sq: np.ndarray, d_ids: np.ndarray, limit: int):
    """Row and column indexes, rounded distances and cosines of the ``limit`` best per query row.

    The matrix product only preselects; what lies within rounding of the cut is measured exactly.
    """
    approx = squared_distances(q, d, d_sq)
    if d.shape[0] > limit:
        cut = np.sqrt(np.partition(approx, limit - 1, axis=1)[:, limit - 1])
        scale = np.sqrt((q * q).sum(1) + d_sq.max())
        reach = cut + SLACK + 1e-7 * scale
        rows, cols = np.nonzero(approx <= (reach * reach)[:, None])
    else:
        rows, cols = (a.ravel() for a in np.indices(approx.shape))
    q_norm, d_norm = np.linalg.norm(q, axis=1) + 1e-8, np.sqrt(d_sq) + 1e-8
    dist, cosine = np.empty(len(rows)), np.empty(len(rows))
    for lo in range(0, len(rows), 65_536):
        r, c = rows[lo:lo + 65_536], cols[lo:lo + 65_536]
        diff = q[r] - d[c]
        dist[lo:lo + 65_536] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        cosine[lo:lo + 65_536] = np.einsum("ij,ij->i", q[r], d[c]) / (q_norm[r] * d_norm[c])
    dist = np.round(dist, DIGITS)
    order = np.lexsort((d_ids[cols], dist, rows))
    rows, cols, dist, cosine = rows[order], cols[order], dist[order], cosine[order]
    starts = np.searchsorted(rows, np.arange(len(q)))
    keep = np.arange(len(rows)) - starts[rows] < limit
    return rows[keep], cols[keep], dist[keep], cosine[keep]


def _distinct_vectors(songs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """``(id, rep)`` of all songs, ``(id, embedding, copy, rep)`` of those that can be answers, and the
    number of distinct vectors. The hash spares the sort most comparisons of whole vectors."""
    base = songs.select("id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn(
        "h", F.xxhash64("embedding"))
    firsts = Window.partitionBy("h", "embedding").orderBy("id")
    limited = base.withColumn("copy", F.row_number().over(firsts)).filter(F.col("copy") <= k + 1)
    answers = store(limited.withColumn("rep", F.min("id").over(Window.partitionBy("h", "embedding"))), "vectors")
    kept, distinct = answers.agg(F.count("*"), F.count_if(F.col("copy") == 1)).first()
    if kept == songs.count():
        return answers.select("id", "rep"), answers, distinct
    reps = answers.filter("copy = 1").select("h", "embedding", "rep")
    return base.join(reps, ["h", "embedding"]).select("id", "rep"), answers, distinct


def _pivots(answers: DataFrame, n_distinct: int, cell_rows: int, seed) -> np.ndarray:
    n_cells = max(1, min(MAX_CELLS, math.ceil(n_distinct / cell_rows)))
    drawn = (
        answers.filter("copy = 1").select("embedding", hash_hex(seed, "id").alias("h"), "id")
        .orderBy("h", "id").limit(n_cells).collect()
    )
    return np.array([r["embedding"] for r in drawn], dtype=np.float64)


def _block_rows(pivots: np.ndarray) -> int:
    """Rows handled at once, so that a distance block stays near BLOCK_CELLS."""
    return max(16, BLOCK_CELLS // len(pivots))


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell``, the nearest pivot."""
    if len(pivots) == 1:
        return df.withColumn("cell", F.lit(0))

    @F.arrow_udf("int")
    def nearest(batch: pa.Array) -> pa.Array:
        x, step = as_matrix(batch), _block_rows(pivots)
        cells = [squared_distances(x[lo:lo + step], pivots).argmin(1) for lo in range(0, len(x), step)]
        return pa.array(np.concatenate(cells).astype(np.int32) if cells else [], pa.int32())

    return df.withColumn("cell", nearest("embedding"))


def _with_lookup(df: DataFrame, cell: str, values: np.ndarray, out: str) -> DataFrame:
    """Add a per-cell number; a literal for few cells, a broadcast table of at most MAX_CELLS rows else."""
    if len(values) <= 64:
        return df.withColumn(out, F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(cell) + 1))
    rows = [(i, int(v)) for i, v in enumerate(values)]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, f"{cell} int, {out} long")), cell)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` nearest ids of each representative, nearest first."""
    order = Window.partitionBy("rep").orderBy("dist", "id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).drop("_r")


def nearest(songs: DataFrame, k: int, *, queries: DataFrame | None = None, cell_rows: int = CELL_ROWS,
            chunk_rows: int = CHUNK_ROWS, seed: str = "pivot") -> DataFrame:
    """``(src, dst, rank, dist, cosine)``: the ``k`` nearest other songs of every song that has a vector.

    Distances are rounded to six digits and ties go to the lower id. ``queries`` with a column ``id`` restricts ``src`` to those
    songs; only they are searched for. Blocks have at most ``chunk_rows`` rows. ``vector_index`` has the approximate search.
    """
    asked = queries
    songs = songs.filter(has_vector())
    id_type = songs.schema["id"].dataType.simpleString()
    members, answers, n_distinct = _distinct_vectors(songs, k)
    if not n_distinct:
        return songs.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("rank"),
                            F.lit(0.0).alias("dist"), F.lit(0.0).alias("cosine")).limit(0)
    pivots = _pivots(answers, n_distinct, cell_rows, seed)
    placed = _assign(answers, pivots)
    if len(pivots) > 1:
        placed = store(placed, "placed")
    sizes, homes = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots), dtype=np.int64)
    for row in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.col("copy") == 1).alias("q")).collect():
        sizes[row["cell"]], homes[row["cell"]] = row["n"], row["q"]
    queries, n_queries = placed.filter("copy = 1").select(F.col("id").alias("rep"), "embedding", "cell"), n_distinct
    if asked is not None:
        members = store(members.join(asked.select("id").distinct(), "id", "left_semi"), "asked")
        reps = store(members.select("rep").distinct(), "asked-reps")
        queries, n_queries = queries.join(reps, "rep", "left_semi"), reps.count()
    groups, slices = group_counts(songs.sparkSession, n_queries, int(sizes.sum()))
    # Queries are dealt in the order of their cells, so that those of a group lie close and start with the blocks of their cells.
    before = np.concatenate([[0], np.cumsum(homes)])
    first, last = before[:-1] * groups // max(n_distinct, 1), np.minimum(before[1:] * groups // max(n_distinct, 1), groups - 1)
    spot = F.col("before") + hex_uniform(hash_hex("query", "rep")) * F.col("homes")
    dealt = _with_lookup(_with_lookup(queries, "cell", before[:-1], "before"), "cell", homes, "homes").select(
        F.col("rep").alias("id"), "embedding", "cell", F.least(F.floor(spot * groups / n_distinct), F.lit(groups - 1)).cast("int").alias("key"))
    block_rows = min(chunk_rows, BLOCK_ROWS)
    parts = np.maximum(1, -(-sizes // CHUNK_ROWS))
    data = _with_lookup(placed, "cell", parts, "n_chunks").withColumn("chunk", (hash_bucket(hash_hex("chunk", "id"), 7) % F.col("n_chunks")).cast("int"))
    data = data.repartition("cell", "chunk").select(F.col("cell").alias("key"), "id", "cell", "embedding")
    blocks = _with_lookup(_with_lookup(pack(data, block_rows), "key", first, "first"), "key", last, "last")
    found = deal(pack(dealt, block_rows), store(blocks, "blocks"), groups, slices, k + 1, F.col("group").between(F.col("first"), F.col("last")))
    return _per_member(members, _best(found, k), k)


def _per_member(members: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Give every copy its representative's list without itself; lists are bounded by ``k + 1``."""
    lists = best.groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("dist", "id", "cosine"))).alias("near"))
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col("src")), 1, k)
    return (
        members.withColumnRenamed("id", "src").join(lists, "rep")
        .select("src", F.posexplode(others).alias("pos", "e"))
        .select("src", F.col("e.id").alias("dst"), (F.col("pos") + 1).alias("rank"),
                F.col("e.dist").alias("dist"), F.col("e.cosine").alias("cosine"))
    )


def knn_l2(songs: DataFrame, k: int, **sizes) -> DataFrame:
    """Exact ``k`` nearest neighbours by L2, the song itself excluded by id."""
    return nearest(songs, k, **sizes)
