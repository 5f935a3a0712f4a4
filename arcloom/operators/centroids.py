"""Distances to a small set of centroids.

A centroid set is model state: one vector per mood, and every mood vector in the library is an
array of that length. It is read once, checked against ``MAX_CENTROIDS`` and shipped to the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.vectors import tidy

MAX_CENTROIDS = 4096


def as_matrix(arr: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a 2-d array, without copying through Python lists.

    Rows that are null, hold a null or have another length than ``width`` (else that of the first list) become NaN.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.empty((0, width or 0))
    lengths = pc.fill_null(pc.list_value_length(arr), -1).to_numpy(zero_copy_only=False)
    width = width if width is not None else int(lengths[np.argmax(lengths >= 0)])
    fits = lengths == width
    if fits.all():
        return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1).astype(np.float64, copy=False)
    out = np.full((len(arr), max(width, 0)), np.nan)
    if fits.any():
        out[fits] = arr.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(int(fits.sum()), -1)
    return out


def has_vector(vector="embedding") -> Column:
    """Is it a vector without nulls? Others have no place in a vector space."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())


def pair_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``x`` to all rows of ``c`` from plain differences."""
    out = np.empty((len(x), len(c)))
    for j, row in enumerate(c):
        diff = x - row
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def centroids_of(assigned: DataFrame, label="label", vector="embedding") -> DataFrame:
    """Mean vector per label: ``(label_id, centroid)``; partial sums are combined before the shuffle."""
    return (
        assigned.groupBy(F.col(label).alias("label_id"))
        .agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("centroid"))
    )


def read_centroids(centroids: DataFrame) -> tuple[list[int], np.ndarray]:
    rows = centroids.select("label_id", "centroid").limit(MAX_CENTROIDS + 1).collect()
    if len(rows) > MAX_CENTROIDS:
        raise ValueError(f"a mood space has at most {MAX_CENTROIDS} centroids")
    rows.sort(key=lambda r: r["label_id"])
    return [r["label_id"] for r in rows], np.array([r["centroid"] for r in rows], dtype=np.float64)


def _list_column(matrix: np.ndarray) -> pa.Array:
    """One list per row; rows with NaN are null."""
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    lost = np.isnan(matrix).any(1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()), mask=pa.array(lost) if lost.any() else None)


def distances_column(vector: Column, matrix: np.ndarray) -> Column:
    """``array<double>`` of distances to the rows of ``matrix``, computed on Arrow batches."""

    @F.arrow_udf("array<double>")
    def distances(batch: pa.Array) -> pa.Array:
        if len(batch) == 0:
            return pa.array([], type=pa.list_(pa.float64()))
        return _list_column(pair_distances(as_matrix(batch, matrix.shape[1]), matrix))

    return distances(vector.cast("array<double>"))


def softmax_column(vector: Column, matrix: np.ndarray, sharpness: float) -> Column:
    """Softmax of -sharpness*distance, shifted by the row maximum."""

    @F.arrow_udf("array<double>")
    def shares(batch: pa.Array) -> pa.Array:
        if len(batch) == 0:
            return pa.array([], type=pa.list_(pa.float64()))
        logits = -sharpness * pair_distances(as_matrix(batch, matrix.shape[1]), matrix)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return _list_column(e / e.sum(axis=1, keepdims=True))

    return shares(vector.cast("array<double>"))


def with_distances(songs: DataFrame, centroids: DataFrame, vector="embedding", out="distances"):
    """Songs plus an array of distances in label order; also returns the label order."""
    label_ids, matrix = read_centroids(centroids)
    return songs.withColumn(out, distances_column(F.col(vector), matrix)), label_ids


def label_array(label_ids) -> Column:
    return F.array(*[F.lit(int(i)) for i in label_ids])


def song_centroid_distance(songs: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(id, label_id, dist)`` for every song with a vector and every centroid; no shuffle."""
    wide, label_ids = with_distances(songs.select("id", "embedding"), centroids)
    return wide.select("id", F.posexplode("distances").alias("pos", "dist")).select(
        "id", F.element_at(label_array(label_ids), F.col("pos") + 1).alias("label_id"), "dist")


def kmeans_assign(songs: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nearest centroid of each song: ``(id, label_id, dist)``; the lower label wins ties, no vector gives nulls."""
    wide, label_ids = with_distances(songs, centroids)
    least = F.array_min("distances")
    return wide.select(
        *[c for c in songs.columns if c not in ("label_id", "dist")],
        F.when(F.col("distances").isNotNull(), F.element_at(
            label_array(label_ids), F.array_position("distances", least).cast("int"))).alias("label_id"),
        least.alias("dist"),
    )


def kmeans_update(assigned: DataFrame, label="label_id") -> DataFrame:
    """New centroids after an assignment."""
    return centroids_of(assigned, label)


def kmeans_inertia(assigned: DataFrame, centroids: DataFrame, label="label_id") -> DataFrame:
    """Sum of squared distances of songs to the centroid they are assigned to."""
    wide, label_ids = with_distances(assigned, centroids)
    own = F.element_at("distances", F.array_position(label_array(label_ids), F.col(label)).cast("int"))
    return wide.agg(F.sum(own * own).alias("inertia"))


def cluster_sizes(assigned: DataFrame, clusters: DataFrame, label="label_id") -> DataFrame:
    """Rows per cluster, empty clusters included."""
    counts = assigned.groupBy(F.col(label).alias("label_id")).agg(F.count("*").alias("n"))
    return clusters.select("label_id").join(counts, "label_id", "left").select(
        "label_id", F.coalesce("n", F.lit(0)).alias("size"))


def cluster_exemplars(assigned: DataFrame, centroids: DataFrame, k: int = 5, label="label_id") -> DataFrame:
    """The ``k`` songs nearest to their own centroid, with rounded features."""
    wide, label_ids = with_distances(assigned, centroids)
    own = F.element_at("distances", F.array_position(label_array(label_ids), F.col(label)).cast("int"))
    best = Window.partitionBy("cluster_id").orderBy("distance", "id")
    return (
        wide.select(
            F.col(label).alias("cluster_id"), "id", tidy(own, 6).alias("distance"), "name", "artist",
            tidy(F.coalesce("tempo", F.lit(0.0)), 1).alias("tempo"),
            tidy(F.coalesce("energy", F.lit(0.0)), 3).alias("energy"),
            tidy(F.coalesce("valence", F.lit(0.0)), 3).alias("valence"),
            tidy(F.coalesce("danceability", F.lit(0.0)), 3).alias("danceability"),
        )
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )


def label_clusters(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach ``label`` and ``description``; unnamed clusters become ``cluster_<id>`` and ''."""
    return clusters.join(labels.select("label_id", "label", "description"), "label_id", "left").withColumns({
        "label": F.coalesce("label", F.concat(F.lit("cluster_"), F.col("label_id").cast("string"))),
        "description": F.coalesce("description", F.lit("")),
    })


def mood_profiles(songs: DataFrame, centroids: DataFrame, sharpness: float = 1.0, digits: int = 4) -> DataFrame:
    """Songs plus ``scores``: softmax of -sharpness*distance over the moods, in label order.

    ``mood_ids`` carries the label order. The whole step is one scan; nothing is shuffled.
    """
    label_ids, matrix = read_centroids(centroids)
    raw = softmax_column(F.col("embedding"), matrix, float(sharpness))
    return songs.withColumn("_raw", raw).withColumns({
        "scores": F.transform("_raw", lambda s: F.round(s, digits)),
        "mood_ids": label_array(label_ids),
    }).drop("_raw")


def mood_scores(songs: DataFrame, centroids: DataFrame, sharpness: float = 1.0) -> DataFrame:
    """Long form ``(song_id, label_id, score)``."""
    return long_scores(mood_profiles(songs.select("id", "embedding"), centroids, sharpness))


def long_scores(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        F.col("id").alias("song_id"), "mood_ids", F.posexplode("scores").alias("pos", "score")
    ).select("song_id", F.element_at("mood_ids", F.col("pos") + 1).alias("label_id"), "score")


def centroid_similarity(centroids: DataFrame) -> DataFrame:
    """``(i, j, sim)`` for i < j with ``sim = 1 - d / (max d + 1e-8)``."""
    as_songs = centroids.select(F.col("label_id").alias("i"), F.col("centroid").alias("embedding"))
    wide, label_ids = with_distances(as_songs, centroids)
    far = wide.agg(F.max(F.array_max("distances"))).scalar()
    return (
        wide.select("i", F.posexplode("distances").alias("pos", "dist"))
        .select("i", F.element_at(label_array(label_ids), F.col("pos") + 1).alias("j"),
                (F.lit(1.0) - F.col("dist") / (far + F.lit(1e-8))).alias("sim"))
        .filter(F.col("i") < F.col("j"))
    )
