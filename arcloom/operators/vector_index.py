"""Approximate neighbours over a stored two-level inverted file with calibrated probes.

``build_index`` writes, once, the distinct vectors (and of equal ones the ``k + 1`` lowest ids, which are all that can be
answers) into cells. The square root of the number of cells are coarse cells around pivots drawn by hash; inside each
coarse cell about one vector in ``cell_rows`` is drawn as the pivot of a cell, so dense regions have more cells and cells stay of
like size. Only the coarse pivots are ever broadcast: their number grows with the square root of the table and is checked. Vectors
are partitioned by coarse cell on disk, so few queries read few folders.

``calibrate`` finds the probes for a wanted recall: for a block of at most ``BLOCK`` vectors drawn by hash, exact neighbours come from one
scan, and for each of them the place of its cell in the query's order of cells is counted. The shares of neighbours that
lie within the first coarse cells, and then within the first cells, give both numbers at once, without trial searches. ``MARGIN`` allows
for the error of a block.

``search`` takes any vectors. Queries are dealt to groups by their nearest coarse cell, a group gets the pivots of all cells and the packed
vectors of the coarse cells it asks for, and each query meets the vectors of its nearest cells (``block_search``). Cells are added
beyond the probes until they hold enough vectors.

Vectors that are null or hold a null are left out, on both sides. An empty table gives an index without answers.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.functions.hashing import hash_bucket, hash_hex, hex_uniform, uniform
from arcloom.operators.block_search import BLOCK_ROWS, DIGITS, SLACK, deal, group_counts, pack
from arcloom.operators.centroids import as_matrix, has_vector
from arcloom.operators.neighbours import _best, _distinct_vectors, _per_member, local_best, squared_distances
from arcloom.sources.workspace import new_path, store

CELL_ROWS = 1_000
CHUNK_ROWS = 8_000
MAX_COARSE = 4096
BLOCK = 256
RECALL, MARGIN = 0.9, 0.02


@dataclass(frozen=True)
class Probes:
    """Cells to visit, and the share of a block's neighbours found with them."""

    coarse: int
    cells: int
    recall: float


@dataclass(frozen=True)
class VectorIndex:
    """Folder of the tables ``vectors``, ``pivots``, ``coarse`` and ``members``, and for how many neighbours they serve."""

    path: str
    k: int
    rows: int
    id_type: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def coarse(self, spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
        """Pivots and sizes of the coarse cells."""
        rows = self.table(spark, "coarse").orderBy("coarse").collect()
        return np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["n"] for r in rows], dtype=np.int64)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(**json.loads(spark.read.parquet(f"{path}/state").first()["state"]))


def _nearest_coarse(pivots: np.ndarray):
    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        x = as_matrix(vectors)
        return pa.array(squared_distances(x, pivots).argmin(1).astype(np.int32) if len(x) else [], pa.int32())

    return nearest


def _chunked(df: DataFrame, rows, salt: str) -> DataFrame:
    """``chunk`` of each row among as many as ``rows`` of its cell need."""
    parts = F.greatest(F.ceil(rows / CHUNK_ROWS), F.lit(1))
    return df.withColumn("chunk", (hash_bucket(hash_hex(salt, "id"), 7) % parts).cast("int"))


def build_index(songs: DataFrame, k: int, *, cell_rows: int = CELL_ROWS, seed: str = "pivot") -> VectorIndex:
    """Index of ``songs (id, embedding)`` for up to ``k`` neighbours."""
    spark = songs.sparkSession
    songs = songs.filter(has_vector())
    members, answers, distinct = _distinct_vectors(songs, k)
    path = new_path(spark, "vector-index")
    index = VectorIndex(path, k, distinct, songs.schema["id"].dataType.simpleString())
    spark.createDataFrame([(json.dumps(asdict(index)),)], "state string").coalesce(1).write.parquet(f"{path}/state")
    if not distinct:
        return index
    wanted = max(1, math.ceil(math.sqrt(math.ceil(distinct / cell_rows))))
    if wanted > MAX_COARSE:
        raise ValueError(f"{wanted} coarse cells; choose cell_rows of at least {math.ceil(distinct / MAX_COARSE**2)}")
    drawn = answers.filter("copy = 1").select("id", "embedding", hash_hex(seed, "id").alias("h")).orderBy("h", "id").limit(wanted).collect()
    pivots = np.array([r["embedding"] for r in drawn], dtype=np.float64)
    placed = answers.select("id", "rep", "copy", "embedding").withColumn(
        "coarse", _nearest_coarse(pivots)("embedding") if wanted > 1 else F.lit(0))
    placed = store(placed, "coarse-cells")
    sizes = {r["coarse"]: r["n"] for r in placed.groupBy("coarse").agg(F.count("*").alias("n")).collect()}
    spark.createDataFrame([(i, r["embedding"], sizes.get(i, 0)) for i, r in enumerate(drawn)], "coarse int, embedding array<double>, n long").coalesce(1).write.parquet(f"{path}/coarse")
    counted = spark.createDataFrame(list(sizes.items()), "coarse int, coarse_rows long")
    is_pivot = F.col("id").isin([r["id"] for r in drawn]) | (uniform("cell", "id") < 1.0 / cell_rows)
    fine = store(placed.filter((F.col("copy") == 1) & is_pivot).select(F.col("id").alias("cell"), F.col("embedding").alias("pivot"), "coarse"), "cell-pivots")
    left = _chunked(placed.join(F.broadcast(counted), "coarse"), F.col("coarse_rows"), "chunk").drop("coarse_rows")
    parts = F.greatest(F.ceil(F.col("coarse_rows") / CHUNK_ROWS), F.lit(1)).cast("int")
    right = fine.join(F.broadcast(counted), "coarse").withColumn("chunk", F.explode(F.sequence(F.lit(0), parts - 1))).drop("coarse_rows")

    def assign(data: pa.Table, cells: pa.Table) -> pa.Table:
        if not data.num_rows:
            return pa.table({"id": data["id"], "rep": data["rep"], "copy": data["copy"], "embedding": data["embedding"], "coarse": data["coarse"],
                             "cell": pa.array([], cells["cell"].type)})
        cells = cells.sort_by("cell")
        x, p = as_matrix(data["embedding"]), as_matrix(cells["pivot"])
        step = max(16, 1_000_000 // len(p))
        at = np.concatenate([squared_distances(x[i : i + step], p).argmin(1) for i in range(0, len(x), step)])
        return data.select(["id", "rep", "copy", "embedding", "coarse"]).append_column("cell", cells["cell"].take(pa.array(at)))

    kind = f"id {index.id_type}, rep {index.id_type}, copy int, embedding array<double>, coarse int, cell {index.id_type}"
    cells = left.groupBy("coarse", "chunk").cogroup(right.groupBy("coarse", "chunk")).applyInArrow(assign, kind)
    cells.repartition("coarse").write.partitionBy("coarse").parquet(f"{path}/vectors")
    counts = index.table(spark, "vectors").groupBy("cell").agg(F.count("*").alias("n"))
    fine.join(counts, "cell").write.parquet(f"{path}/pivots")
    members.write.parquet(f"{path}/members")
    return index


def block_of(spark: SparkSession, index: VectorIndex, size: int = BLOCK) -> list:
    """The vectors of the index with the ``size`` smallest hashes."""
    first = index.table(spark, "vectors").filter("copy = 1")
    return first.select("id", "embedding", hash_hex("block", "id").alias("h")).orderBy("h", "id").limit(size).collect()


def _exact_of_block(spark: SparkSession, index: VectorIndex, queries: np.ndarray, limit: int) -> list:
    """The ``limit`` nearest rows of every query, with their cells: one scan, bounded rows from every task."""
    shared = spark.sparkContext.broadcast(queries)

    def scan(batches):
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).sort_by("id")
            d = as_matrix(rows["embedding"])
            q, at, dist, _ = local_best(shared.value, d, (d * d).sum(1), np.arange(len(d)), limit)
            found = pa.table({"q": pa.array(q, pa.int32()), "dist": pa.array(dist)}).append_column("id", rows["id"].take(pa.array(at))).append_column(
                "coarse", rows["coarse"].take(pa.array(at))).append_column("cell", rows["cell"].take(pa.array(at)))
            found = pa.concat_tables([best, found]) if best is not None else found
            found = found.sort_by([("q", "ascending"), ("dist", "ascending"), ("id", "ascending")])
            q = found["q"].to_numpy()
            best = found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < limit))
        if best is not None:
            yield from best.to_batches()

    kind = f"q int, dist double, id {index.id_type}, coarse int, cell {index.id_type}"
    near = index.table(spark, "vectors").select("id", "embedding", "coarse", "cell").mapInArrow(scan, kind)
    first = Window.partitionBy("q").orderBy("dist", "id")
    return near.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= limit).drop("r").collect()


def _cells_before(spark: SparkSession, index: VectorIndex, queries: np.ndarray, allowed: np.ndarray, pairs: list) -> np.ndarray:
    """For each pair of a query and a cell: how many allowed cells are nearer to the query."""
    wanted = spark.createDataFrame([(c,) for c in sorted({p["cell"] for p in pairs})], f"cell {index.id_type}")
    pivots = index.table(spark, "pivots")
    places = {r["cell"]: r["pivot"] for r in pivots.join(F.broadcast(wanted), "cell").select("cell", "pivot").collect()}
    q = np.array([p["q"] for p in pairs])
    reach = np.sqrt(((queries[q] - np.array([places[p["cell"]] for p in pairs])) ** 2).sum(1))
    shared = spark.sparkContext.broadcast((queries, allowed, q, reach, [p["cell"] for p in pairs]))

    def count(batches):
        queries, allowed, q, reach, cells = shared.value
        total = np.zeros(len(q), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                names = part.column(0).to_pylist()
                at = {c: i for i, c in enumerate(names)}
                d = np.sqrt(squared_distances(queries, as_matrix(part.column(1))))
                d[~allowed[:, part.column(2).to_numpy()]] = np.inf
                near = d[q] < reach[:, None]
                here = [(i, at[c]) for i, c in enumerate(cells) if c in at]
                if here:
                    near[tuple(zip(*here))] = False
                total += near.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q), dtype=np.int32)), pa.array(total)], ["pair", "n"])

    counts = pivots.select("cell", "pivot", "coarse").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(pairs), np.int64)
    for r in counts:
        out[r["pair"]] = r["n"]
    return out


def _least(places: np.ndarray, share: float) -> int:
    """The least number of first places that hold at least this share."""
    return int(np.sort(places)[max(0, math.ceil(share * len(places) - 1e-9) - 1)]) + 1


def calibrate(spark: SparkSession, index: VectorIndex, k: int | None = None, recall: float = RECALL, margin: float = MARGIN, size: int = BLOCK) -> Probes:
    """Probes with which a block drawn by hash finds ``recall + margin`` of its ``k`` nearest, half of what may be lost by coarse cells."""
    k = index.k if k is None else k
    block = block_of(spark, index, size) if index.rows else []
    if len(block) < 2:
        return Probes(1, 1, 1.0)
    queries = np.array([r["embedding"] for r in block], dtype=np.float64)
    found = sorted(_exact_of_block(spark, index, queries, k + 1), key=lambda r: (r["q"], r["dist"], r["id"]))
    pairs, taken = [], [0] * len(block)
    for r in found:
        if r["id"] != block[r["q"]]["id"] and taken[r["q"]] < k:
            taken[r["q"]] += 1
            pairs.append(r)
    share = min(1.0, recall + margin)
    coarse, _ = index.coarse(spark)
    order = np.argsort(np.argsort(squared_distances(queries, coarse), axis=1, kind="stable"), axis=1, kind="stable")
    place = order[[p["q"] for p in pairs], [p["coarse"] for p in pairs]]
    first = _least(place, 1 - (1 - share) / 2)
    inside = place < first
    before = _cells_before(spark, index, queries, order < first, pairs)
    before = np.where(inside, before, np.iinfo(np.int64).max - 1)
    cells = _least(before, share)
    return Probes(first, cells, float((before < cells).mean()))


def _coarse_order(x: np.ndarray, coarse: np.ndarray, sizes: np.ndarray, probes: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """The coarse cells of each vector, nearest first, and which of these it visits: ``probes`` of them, more while they hold too few rows."""
    near = np.argsort(squared_distances(x, coarse), axis=1, kind="stable")
    held = np.cumsum(sizes[near], axis=1) - sizes[near]
    return near, (np.arange(len(coarse)) < probes) | (held < enough)


def _order(coarse: np.ndarray, sizes: np.ndarray, probes: int, enough: int):
    """The visited coarse cells of a vector as a column."""

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        x, out = as_matrix(vectors), []
        for lo in range(0, len(x), 1024):
            near, keep = _coarse_order(x[lo : lo + 1024], coarse, sizes, probes, enough)
            out += [row[k].astype(np.int32) for row, k in zip(near, keep)]
        return pa.array(out, pa.list_(pa.int32()))

    return cells


def _visits(coarse: np.ndarray, sizes: np.ndarray, probes: Probes, enough: int):
    """For the queries of a group: the place of each cell, and per place one bit for each query that visits the cell.

    A query visits the nearest cells of its coarse cells, by distance and then by id, and more while they hold too few rows.
    """
    def choose(q: np.ndarray, pivots: list) -> tuple[dict, np.ndarray]:
        names = [c for ids, _, _ in pivots for c in ids.to_pylist()]
        x = np.concatenate([x for _, x, _ in pivots])
        notes = np.concatenate([n.to_numpy() for _, _, n in pivots])
        rows, home = notes // MAX_COARSE, notes % MAX_COARSE
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        bits = np.zeros((len(names), -(-len(q) // 8)), np.uint8)
        for lo in range(0, len(q), 512):
            part = q[lo : lo + 512]
            near, keep = _coarse_order(part, coarse, sizes, probes.coarse, enough)
            allowed = np.zeros((len(part), len(coarse)), bool)
            np.put_along_axis(allowed, near, keep, axis=1)
            allowed = allowed[:, home]
            mask = _nearest_cells(part, x, allowed, rank, rows, probes.cells, enough)
            bits[:, lo // 8 : lo // 8 + -(-len(part) // 8)] = np.packbits(mask.T, axis=1)
        return {c: i for i, c in enumerate(names)}, bits

    return choose


def _nearest_cells(q, x, allowed, rank, rows, probes: int, enough: int) -> np.ndarray:
    """Which of the allowed cells each query visits. The matrix product only preselects; what lies within rounding of the cut is measured exactly."""
    def ordered(i, some):
        return some[np.lexsort((rank[some], np.round(np.sqrt(((q[i] - x[some]) ** 2).sum(1)), DIGITS)))]

    mask = allowed.copy()
    if probes < len(x):
        d = np.sqrt(squared_distances(q, x))
        d[~allowed] = np.inf
        cut = np.partition(d, probes - 1, axis=1)[:, probes - 1]
        slack = (SLACK + 1e-7 * (1 + np.sqrt((q * q).sum(1) + (x * x).sum(1).max())))[:, None]
        some = np.flatnonzero(np.isfinite(cut))
        sure = d[some] < cut[some, None] - slack[some]
        close = ~sure & (d[some] <= cut[some, None] + slack[some])
        mask[some] = sure | close
        for j in np.flatnonzero(sure.sum(1) + close.sum(1) > probes):
            border = np.flatnonzero(close[j])
            mask[some[j], border] = False
            mask[some[j], ordered(some[j], border)[: probes - sure[j].sum()]] = True
    for i in np.flatnonzero((mask @ rows < enough) & (mask.sum(1) < allowed.sum(1))):
        cells = ordered(i, np.flatnonzero(allowed[i]))
        held = np.cumsum(rows[cells]) - rows[cells]
        mask[i, cells[(np.arange(len(cells)) < probes) | (held < enough)]] = True
    return mask


def search(index: VectorIndex, queries: DataFrame, k: int | None = None, probes: Probes | None = None) -> DataFrame:
    """``(query, id, dist, cosine)``: up to ``k + 1`` nearest rows of every one of ``queries (query, embedding)``.

    Equal vectors of the index count as rows; ``query`` is unique. Without ``probes`` they are calibrated.
    """
    spark = queries.sparkSession
    k = index.k if k is None else k
    if k > index.k:
        raise ValueError(f"the index serves up to {index.k} neighbours")
    probes = probes or calibrate(spark, index, k)
    kind = queries.schema["query"].dataType.simpleString()
    empty = f"query {kind}, id {index.id_type}, dist double, cosine double"
    if not index.rows:
        return spark.createDataFrame([], empty)
    queries = queries.filter(has_vector()).select("query", F.col("embedding").cast("array<double>").alias("embedding"))
    coarse, sizes = index.coarse(spark)
    enough = min(k + 1, int(sizes.sum()))
    asked = store(queries.withColumn("near", _order(coarse, sizes, probes.coarse, enough)("embedding")).withColumn("home", F.element_at("near", 1)), "asked")
    homes = {r["home"]: r["n"] for r in asked.groupBy("home").agg(F.count("*").alias("n")).collect()}
    total = sum(homes.values())
    if not total:
        return spark.createDataFrame([], empty)
    groups, slices = group_counts(spark, total, int(sizes.sum()))
    # Queries are dealt in the order of their coarse cells, so that those of a group visit the same ones.
    starts, at = [], 0
    for home, n in sorted(homes.items()):
        starts.append((home, at, n))
        at += n
    spot = F.col("first") + hex_uniform(hash_hex("query", "query")) * F.col("n")
    dealt = asked.join(F.broadcast(spark.createDataFrame(starts, "home int, first long, n long")), "home").withColumn(
        "group", F.least(F.floor(spot * groups / total), F.lit(groups - 1)).cast("int"))
    wanted = dealt.select("group", F.explode("near").alias("key")).distinct()
    pivots = index.table(spark, "pivots").select(F.lit(0).alias("key"), F.col("cell").alias("id"), (F.col("n") * MAX_COARSE + F.col("coarse")).alias("cell"), F.col("pivot").alias("embedding"))
    data = index.table(spark, "vectors").select(F.col("coarse").cast("int").alias("key"), "id", "cell", "embedding")
    block_rows = min(CHUNK_ROWS, BLOCK_ROWS)
    asking = dealt.select(F.col("group").alias("key"), F.col("query").alias("id"), F.col("home").alias("cell"), "embedding")
    found = deal(pack(asking, block_rows), store(pack(data, block_rows), "blocks"), groups, slices, k + 1, wanted=wanted, pivots=pack(pivots, block_rows),
                 chooser=_visits(coarse, sizes, probes, enough))
    return _best(found, k).withColumnRenamed("rep", "query")


def knn_approx(songs: DataFrame, k: int, *, recall: float = RECALL, cell_rows: int = CELL_ROWS, index: VectorIndex | None = None,
               probes: Probes | None = None, queries: DataFrame | None = None) -> DataFrame:
    """``(src, dst, rank, dist, cosine)`` like the exact search, with probes calibrated for ``recall`` unless they are given.

    A stored ``index`` of the same songs saves building it; ``queries (id)`` restricts ``src``.
    """
    spark = songs.sparkSession
    index = index or build_index(songs, k, cell_rows=cell_rows)
    if not index.rows:
        return spark.createDataFrame([], f"src {index.id_type}, dst {index.id_type}, rank int, dist double, cosine double")
    members = index.table(spark, "members")
    if queries is not None:
        members = store(members.join(queries.select("id").distinct(), "id", "left_semi"), "asked")
    reps = index.table(spark, "vectors").filter("copy = 1").select(F.col("id").alias("query"), "embedding")
    if queries is not None:
        reps = reps.join(members.select(F.col("rep").alias("query")).distinct(), "query", "left_semi")
    probes = probes or calibrate(spark, index, k, recall)
    found = search(index, reps, k, probes).withColumnRenamed("query", "rep")
    return _per_member(members, found, k)
