"""Nearest rows of many queries, from blocks of packed vectors that pass by.

Vectors are packed into rows of about ``BLOCK_ROWS``. The queries are dealt to groups, and every group meets the blocks one after
the other: it keeps the ``limit`` best rows of each of its queries and measures only what may still be among them, so that
a query leaves with one list, however many blocks it has met. A block is left out for queries which the triangle inequality or, with an
index, their probes rule out.

The number of groups is that of the tasks wanted, and more only where a group would exceed ``QUERY_ROWS`` queries; so the
bytes moved grow like the tables, while the distances of structureless vectors stay quadratic. A task holds its queries with their lists and one
block. Few queries are met by slices of the blocks in parallel, whose lists are merged afterwards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.operators.centroids import as_matrix

BLOCK_ROWS = 1024
#: Queries of a group: fewer are not worth a group of their own, more would not fit.
LEAST_ROWS, QUERY_ROWS = 256, 16_384
DIGITS = 6
SLACK = 10.0**-DIGITS * 2
PENDING = 500_000


def group_counts(spark: SparkSession, queries: int, rows: int) -> tuple[int, int]:
    """Groups of queries, and slices of the blocks for each of them."""
    tasks = max(4 * spark.sparkContext.defaultParallelism, 1)
    groups = max(1, min(tasks, math.ceil(queries / LEAST_ROWS)), math.ceil(queries / QUERY_ROWS))
    return groups, max(1, min(math.ceil(tasks / groups), math.ceil(rows / LEAST_ROWS)))


def pack(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(key, ids, cells, vecs, wide)`` of ``rows (key int, id, cell, embedding)``: runs of equal keys, sorted by cell.

    Vectors are packed in single precision where that loses nothing.
    """
    rows = rows.select("key", "id", "cell", "embedding")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "cell")}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, x = batch.column("key").to_numpy(), as_matrix(batch.column("embedding"))
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            cuts = [at for lo, hi in zip(edges, edges[1:]) for at in range(lo, hi, block_rows)] + [len(key)]
            with np.errstate(over="ignore"):
                narrow = x.astype(np.float32)
            wide = not np.array_equal(narrow, x)
            x, offsets = x if wide else narrow, pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[cuts[:-1]], pa.int32()), pa.ListArray.from_arrays(offsets, batch.column("id")), pa.ListArray.from_arrays(offsets, batch.column("cell")),
                 pa.array([x[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])], pa.binary()), pa.array([wide] * (len(cuts) - 1))],
                ["key", "ids", "cells", "vecs", "wide"])

    return rows.sortWithinPartitions("key", "cell").mapInArrow(
        run, f"key int, ids array<{kinds['id']}>, cells array<{kinds['cell']}>, vecs binary, wide boolean")


def _plain(values: pa.Array) -> np.ndarray:
    """Ids that numpy can sort; null integers come last."""
    if pa.types.is_integer(values.type):
        return values.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    return np.array(values.to_pylist(), dtype=object)


class _Best:
    """The ``limit`` best rows of each query of a group among the blocks met so far."""

    def __init__(self, limit: int, chooser=None):
        self.limit, self.chooser = limit, chooser
        self.asked: list = []
        self.cells: list = []
        self.null_id, self.q, self.seen = False, None, None

    def ask(self, ids: pa.Array, x: np.ndarray) -> None:
        self.asked.append((ids, x))

    def place(self, ids: pa.Array, x: np.ndarray, notes: pa.Array) -> None:
        self.cells.append((ids, x, notes))

    def _start(self) -> None:
        self.reps, self.q = pa.concat_arrays([i for i, _ in self.asked]), np.concatenate([x for _, x in self.asked])
        self.norm, self.bound = np.linalg.norm(self.q, axis=1) + 1e-8, np.full(len(self.q), np.inf)
        self.found = [np.empty(0, np.int64), np.empty(0), None, np.empty(0)]
        self.pending: list = []
        self.waiting = 0
        if self.chooser:
            self.cell_at, self.seen = self.chooser(self.q, self.cells)

    def meet(self, ids: pa.Array, x: np.ndarray, cells: pa.Array | None) -> None:
        if not self.asked:
            return
        if self.q is None:
            self._start()
        self.null_id |= ids.null_count > 0
        names, ok = _plain(ids), np.isfinite(x).all(1)
        at = None if self.seen is None else np.array([self.cell_at.get(c, -1) for c in cells.to_pylist()])
        if at is not None:
            ok &= at >= 0
        if not ok.all():
            x, names, at = x[ok], names[ok], at if at is None else at[ok]
        if not len(x):
            return
        centre = x.mean(0)
        d, q = x - centre, self.q - centre
        d_sq, q_sq = (d * d).sum(1), (q * q).sum(1)
        away = np.sqrt(q_sq)
        wanted = away - np.sqrt(d_sq.max()) <= self.bound + SLACK + 1e-7 * (1 + away)
        if at is not None:
            held, at = np.unique(at, return_inverse=True)
            visits = np.unpackbits(self.seen[held], axis=1, count=len(self.q)).astype(bool)
            wanted &= visits.any(0)
        wanted = np.flatnonzero(wanted)
        for lo in range(0, len(wanted), 1024):
            some = wanted[lo : lo + 1024]
            allowed = None if at is None else visits[:, some][at].T
            r, c = _candidates(q[some], q_sq[some], d, d_sq, self.bound[some], self.limit, allowed)
            r = some[r]
            for cut in range(0, len(r), 65_536):
                self._keep(r[cut : cut + 65_536], c[cut : cut + 65_536], x, names)
        if self.waiting > max(PENDING, len(self.found[0]) // 2) or np.isinf(self.bound).any():
            self._settle()

    def _keep(self, r, c, x, names) -> None:
        left, right = self.q[r], x[c]
        diff = left - right
        dist = np.round(np.sqrt(np.einsum("ij,ij->i", diff, diff)), DIGITS)
        near = np.flatnonzero(dist <= self.bound[r])
        cosine = np.einsum("ij,ij->i", left[near], right[near]) / (self.norm[r[near]] * (np.linalg.norm(right[near], axis=1) + 1e-8))
        self.pending.append((r[near], dist[near], names[c[near]], cosine))
        self.waiting += len(near)

    def _settle(self) -> None:
        if not self.waiting:
            return
        parts = self.pending if self.found[2] is None else [tuple(self.found), *self.pending]
        rows, dist, names, cosine = (np.concatenate(p) for p in zip(*parts))
        by_id = names if names.dtype != object else np.unique(names, return_inverse=True)[1]
        order = np.lexsort((by_id, dist, rows))
        starts = np.searchsorted(rows[order], np.arange(len(self.q) + 1))
        order = order[np.arange(len(order)) - starts[rows[order]] < self.limit]
        self.found = [a[order] for a in (rows, dist, names, cosine)]
        starts = np.searchsorted(self.found[0], np.arange(len(self.q) + 1))
        full = np.flatnonzero(np.diff(starts) >= self.limit)
        self.bound[full] = self.found[1][starts[full] + self.limit - 1]
        self.pending, self.waiting = [], 0

    def lists(self):
        if self.q is None:
            return
        self._settle()
        rows, dist, names, cosine = self.found
        for lo in range(0, len(rows), 65_536):
            part = slice(lo, lo + 65_536)
            yield self.reps.take(pa.array(rows[part])), names[part], dist[part], cosine[part]


def _candidates(q, q_sq, d, d_sq, bound, limit: int, allowed=None):
    """Rows and columns that may lie within the bound, or among the ``limit`` best where there is none yet.

    With s = q.d - d.d/2 the squared distance is q.q - 2s. Single precision preselects; its rounding is allowed for.
    """
    scale = np.sqrt(q_sq) * np.sqrt(d_sq.max()) + d_sq.max() / 2
    kind = np.float32 if scale.max(initial=0.0) < 1e12 else np.float64
    slack = scale * (q.shape[1] + 8) * float(np.finfo(kind).eps) + 1e-30
    left = np.empty((len(q), q.shape[1] + 1), kind)
    left[:, :-1], left[:, -1] = q, -0.5
    right = np.empty((len(d), d.shape[1] + 1), kind)
    right[:, :-1], right[:, -1] = d, d_sq
    score = left @ right.T
    reach = bound + SLACK
    fresh = np.flatnonzero(np.isinf(bound))
    if len(fresh) and len(d) > limit:
        known = score[fresh] if allowed is None else np.where(allowed[fresh], score[fresh], -np.inf)
        cut = np.partition(known, len(d) - limit, axis=1)[:, len(d) - limit].astype(np.float64)
        reach[fresh] = np.sqrt(np.maximum(q_sq[fresh] - 2 * cut, 0.0) + 2 * slack[fresh]) + SLACK
    least = (q_sq - reach * reach) / 2 - slack
    least = np.where(np.isfinite(least), least - np.abs(least) * 2 * float(np.finfo(kind).eps), -np.inf).astype(kind)
    hit = score >= least[:, None]
    if allowed is not None:
        hit &= allowed
    return np.nonzero(hit)


def deal(queries: DataFrame, blocks: DataFrame, groups: int, slices: int, limit: int, home: Column | None = None, wanted: DataFrame | None = None,
         pivots: DataFrame | None = None, chooser=None) -> DataFrame:
    """``(rep, id, dist, cosine)``: the ``limit`` best rows of ``blocks`` in every slice for each of the packed ``queries``, whose key is the group.

    ``home`` says of a block and a ``group`` whether they should meet early. ``wanted (key, group)`` says which groups ask for the
    blocks of a key. ``pivots`` go to all groups with a number each, and ``chooser(q, pivots)`` gives a place to
    each cell and, for each place, one bit per query that visits it.
    """
    rep_type, id_type, cell_type = (t.dataType.elementType.simpleString() for t in (queries.schema["ids"], blocks.schema["ids"], blocks.schema["cells"]))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    none = F.lit(None)

    def rows(df: DataFrame, side: int, order: Column, asked: Column, ids: Column) -> DataFrame:
        return df.select((F.col("group") * slices + F.col("slice")).cast("int").alias("at"), F.lit(side).alias("side"), order.alias("order"), asked.alias("asked"), ids.alias("ids"),
                         (F.col("cells") if side == 2 and chooser else none.cast(f"array<{cell_type}>")).alias("cells"), (F.col("cells") if side == 1 else none.cast("array<long>")).alias("notes"), "vecs", "wide")

    no_ask, no_ids = none.cast(f"array<{rep_type}>"), none.cast(f"array<{id_type}>")
    met = blocks.withColumn("slice", F.pmod(F.xxhash64("vecs"), F.lit(slices)).cast("int"))
    if wanted is None:
        met = met.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    else:
        met = met.join(wanted, "key")
    order = F.lit(0) if home is None else F.when(home, 0).otherwise(1)
    stream = rows(queries.withColumnRenamed("key", "group").withColumn("slice", every), 0, F.lit(0), F.col("ids"), no_ids).unionByName(
        rows(met, 2, order, no_ask, F.col("ids")))
    if pivots is not None:
        spread = pivots.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("slice", every)
        stream = stream.unionByName(rows(spread, 1, F.lit(0), no_ask, F.col("ids")))

    def run(batches):
        at, best = None, None
        kinds: tuple = ()
        for batch in batches:
            kinds = batch.schema.field("asked").type.value_type, batch.schema.field("ids").type.value_type
            sides, ats, wide = (batch.column(c).to_pylist() for c in ("side", "at", "wide"))
            for i, side in enumerate(sides):
                if ats[i] != at:
                    yield from _emitted(best, kinds)
                    at, best = ats[i], _Best(limit, chooser)
                ids = batch.column("ids" if side else "asked")[i].values
                x = np.frombuffer(batch.column("vecs")[i].as_buffer(), np.float64 if wide[i] else np.float32).reshape(len(ids), -1).astype(np.float64)
                if side == 0:
                    best.ask(ids, x)
                elif side == 1:
                    best.place(ids, x, batch.column("notes")[i].values)
                else:
                    best.meet(ids, x, batch.column("cells")[i].values if chooser else None)
        yield from _emitted(best, kinds)

    return stream.repartitionById(groups * slices, "at").sortWithinPartitions("at", "side", "order").mapInArrow(
        run, f"rep {rep_type}, id {id_type}, dist double, cosine double")


def _emitted(best, kinds):
    for reps, names, dist, cosine in best.lists() if best is not None else ():
        gone = names == np.iinfo(np.int64).max if best.null_id and names.dtype != object else None
        ids = pa.array(names, from_pandas=False, mask=gone).cast(kinds[1]) if names.dtype != object else pa.array(list(names), kinds[1])
        yield pa.RecordBatch.from_arrays([reps, ids, pa.array(dist), pa.array(cosine)], ["rep", "id", "dist", "cosine"])
