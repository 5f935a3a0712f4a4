"""The transition classifier as a forward pass over song states, for candidate lists and for the walk.

A song's *state* is one array: its vector, its three features and its mood scores, in that order. The network reads both vectors, the
differences of the features and both mood arrays. A fitted model is read once into plain matrices, which every task gets; rows
are scored in Arrow batches by matrix products, so a list of candidates costs one pass. Its size follows from its layers and not from
the data.

A state with a null, or of another length, has no score.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.functions.vectors import as_doubles
from arcloom.operators.centroids import as_matrix
from arcloom.operators.features import pack
from arcloom.sources.workspace import store

N_FEATURES = 3
STEP = 4096
#: Rows and columns of the grid, and the songs of one of them beyond which there are more.
GRID_SIDE, GRID_ROWS = 8, 65_536


def song_states(songs: DataFrame) -> DataFrame:
    """``(id, state)`` of ``songs (id, embedding, tempo, energy, valence, scores)``."""
    return songs.select("id", state_of().alias("state"))


def state_of() -> Column:
    return F.concat(as_doubles("embedding"), pack(["tempo", "energy", "valence"]), F.col("scores").cast("array<double>"))


@dataclass(frozen=True)
class Network:
    """Standardisation, hidden layers of sigmoid units and an output layer of two classes, or of one log-odds."""

    dims: int
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    def probability(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the second class, for every row of states ``a`` and ``b``."""
        d, f = self.dims, self.dims + N_FEATURES
        x = np.concatenate([a[:, :d], b[:, :d], b[:, d:f] - a[:, d:f], a[:, f:], b[:, f:]], axis=1)
        x = (x - self.mean) * self.scale
        with np.errstate(over="ignore"):
            for weights, bias in self.layers[:-1]:
                x = 1.0 / (1.0 + np.exp(-(x @ weights.T + bias)))
            weights, bias = self.layers[-1]
            out = x @ weights.T + bias
            odds = out[:, 1] - out[:, 0] if out.shape[1] == 2 else out[:, 0]
            return 1.0 / (1.0 + np.exp(-odds))


def linear_network(dims: int, weights, bias: float = 0.0) -> Network:
    """A logistic score of the pair features as they are."""
    w = np.asarray(weights, dtype=np.float64)
    return Network(dims, np.zeros(len(w)), np.ones(len(w)), ((w[None, :], np.array([float(bias)])),))


def network_of(model: PipelineModel, dims: int) -> Network:
    """The matrices of a fitted pipeline of scaler and multilayer perceptron; ``dims`` is the length of a vector."""
    scaler, perceptron = model.stages
    std = np.array(scaler.std.toArray())
    flat, sizes, layers, at = np.array(perceptron.weights.toArray()), perceptron.getLayers(), [], 0
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        # Per layer a matrix, column after column, then the biases.
        layers.append((flat[at : at + n_in * n_out].reshape(n_in, n_out).T, flat[at + n_in * n_out : at + (n_in + 1) * n_out]))
        at += (n_in + 1) * n_out
    return Network(dims, np.array(scaler.mean.toArray()), np.divide(1.0, std, out=np.zeros_like(std), where=std > 0), tuple(layers))


def state_scorer(spark: SparkSession, network: Network) -> Callable[[Column, Column], Column]:
    """A function of two state columns."""
    shared, width = spark.sparkContext.broadcast(network), None
    inputs = len(network.mean)
    width = (inputs - N_FEATURES) // 2 + N_FEATURES

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = as_matrix(a, width), as_matrix(b, width)
        parts = [shared.value.probability(x[i : i + STEP], y[i : i + STEP]) for i in range(0, len(x), STEP)]
        out = np.concatenate(parts) if parts else np.zeros(0)
        return pa.array(out, pa.float64(), mask=np.isnan(out))

    return score


def pair_scorer(songs: DataFrame, network: Network) -> Callable[[DataFrame], DataFrame]:
    """Pairs ``(a, b)`` to pairs with ``score``; the form in which a song graph takes a scorer.

    A few pairs carry their states through two joins. Where that would move more than a grid does, the songs of either side are dealt to
    rows and columns of a grid of tasks, which gets every state twice per row or column and every pair once, without states.
    """
    score, states = state_scorer(songs.sparkSession, network), song_states(songs)

    def run(pairs: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in (*pairs.schema, *states.schema)}
        if kinds["a"] == kinds["b"] == kinds["id"] and kinds["id"].simpleString() in ("int", "bigint", "string"):
            pairs = store(pairs, "pairs")
            n_songs, n_pairs = states.count(), pairs.count()
            side = max(GRID_SIDE, math.ceil(n_songs / GRID_ROWS))
            if n_pairs > 2 * side * n_songs:
                return _score_in_grid(pairs, states, network, side)
        both = pairs.join(states.select(F.col("id").alias("a"), F.col("state").alias("_a")), "a").join(
            states.select(F.col("id").alias("b"), F.col("state").alias("_b")), "b")
        return both.withColumn("score", score("_a", "_b")).drop("_a", "_b")

    return run


def _score_in_grid(pairs: DataFrame, states: DataFrame, network: Network, side: int) -> DataFrame:
    """Like the two joins: pairs without a state on both sides have no row, repeated states repeat it.

    A cell reads the states of its row and column first, then its pairs pass by.
    """
    width, shared = (len(network.mean) - N_FEATURES) // 2 + N_FEATURES, states.sparkSession.sparkContext.broadcast(network)
    names = ["b", "a", *[c for c in pairs.columns if c not in ("a", "b")]]
    place, others = lambda c: F.pmod(F.xxhash64(c), F.lit(side)), F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    known = states.filter(F.col("id").isNotNull()).select("id", "state", place("id").alias("p"), others.alias("q"))
    pair_type, id_type = pairs.select(F.struct(*names).alias("p")).schema["p"].dataType.simpleString(), states.schema["id"].dataType.simpleString()
    blank = F.lit(None).cast(pair_type).alias("pair")
    stream = known.select((F.col("p") * side + F.col("q")).cast("int").alias("cell"), F.lit(0).alias("kind"), "id", "state", blank).unionByName(
        known.select((F.col("q") * side + F.col("p")).cast("int").alias("cell"), F.lit(1).alias("kind"), "id", "state", blank)).unionByName(
        pairs.filter("a IS NOT NULL AND b IS NOT NULL").select(
            (place("a") * side + place("b")).cast("int").alias("cell"), F.lit(2).alias("kind"), F.lit(None).cast(id_type).alias("id"),
            F.lit(None).cast("array<double>").alias("state"), F.struct(*names).alias("pair")))

    def run(batches):
        cell, held, sides = None, ([], []), None
        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(cells)]):
                if hi == lo:
                    continue
                if cells[lo] != cell:
                    cell, held, sides = cells[lo], ([], []), None
                part = batch.slice(lo, hi - lo)
                if kinds[lo] < 2:
                    held[kinds[lo]].append((part.column("id"), as_matrix(part.column("state"), width)))
                    continue
                if not held[0] or not held[1]:
                    continue
                sides = sides or [_Side(h) for h in held]
                found = pa.RecordBatch.from_struct_array(part.column("pair"))
                rows, left = sides[0].match(found.column("a"), np.arange(len(found)))
                again, right = sides[1].match(found.column("b").take(pa.array(rows)), np.arange(len(rows)))
                rows, left = rows[again], left[again]
                for at in range(0, len(rows), STEP):
                    some = slice(at, at + STEP)
                    out = shared.value.probability(sides[0].x[left[some]], sides[1].x[right[some]])
                    taken = found.take(pa.array(rows[some]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(out, pa.float64(), mask=np.isnan(out))], [*names, "score"])

    kind = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in names)
    return stream.repartitionById(side * side, "cell").sortWithinPartitions("cell", "kind").mapInArrow(run, f"{kind}, score double")


class _Side:
    """States by id; an id may have several."""

    def __init__(self, parts: list):
        ids, x = pa.concat_arrays([i for i, _ in parts]), np.concatenate([x for _, x in parts])
        coded = ids.dictionary_encode()
        self.ids, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        self.x, self.count = x[order], np.bincount(codes, minlength=len(self.ids))
        self.first = np.cumsum(self.count) - self.count

    def match(self, ids: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The given rows whose id has a state, once for each, and the place of the state."""
        code = pc.fill_null(pc.index_in(ids, value_set=self.ids), -1).to_numpy(zero_copy_only=False)
        rows, code = rows[code >= 0], code[code >= 0]
        n = self.count[code]
        return np.repeat(rows, n), np.repeat(self.first[code], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
