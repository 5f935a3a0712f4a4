"""Scaler, projection and K-means as one saved model that places new songs.

Its parameters are a small table ``(stage, pos, values)``: one row for the means, one for the deviations, one per component and one
per centroid. A row's dimensions do not grow with the songs. Placing a song is one pass of matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.operators.centroids import as_matrix, has_vector
from arcloom.operators.clustering import STARTS, kmeans_fit
from arcloom.operators.features import reduce_dims, scaler_fit
from arcloom.operators.neighbours import squared_distances
from arcloom.sources.workspace import new_path


@dataclass(frozen=True)
class SongModel:
    mean: np.ndarray
    std: np.ndarray
    components: np.ndarray
    centroids: np.ndarray

    def parameters(self, spark: SparkSession) -> DataFrame:
        stages = {"mean": self.mean[None], "std": self.std[None], "component": self.components, "centroid": self.centroids}
        rows = [(name, i, [float(x) for x in row]) for name, matrix in stages.items() for i, row in enumerate(matrix)]
        return spark.createDataFrame(rows, "stage string, pos int, values array<double>")

    def save(self, spark: SparkSession, name: str = "song-model") -> str:
        path = new_path(spark, name)
        self.parameters(spark).coalesce(1).write.parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SongModel:
        rows = sorted(map(tuple, spark.read.parquet(path).collect()), key=lambda r: r[:2])
        stage = {name: np.array([v for n, _, v in rows if n == name]) for name in ("mean", "std", "component", "centroid")}
        return cls(stage["mean"][0], stage["std"][0], stage["component"], stage["centroid"])

    def place(self, songs: DataFrame) -> DataFrame:
        """``songs`` with ``reduced``, ``label_id`` of the nearest centroid, the lower on ties, and ``dist``; null without a vector."""
        shared = songs.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("struct<reduced:array<double>,label_id:int,dist:double>")
        def placed(vectors: pa.Array) -> pa.Array:
            model = shared.value
            x = as_matrix(vectors, len(model.mean))
            y = ((x - model.mean) / model.std) @ model.components.T
            bad = np.isnan(y).any(1) if len(y) else np.zeros(0, bool)
            d = squared_distances(np.nan_to_num(y), model.centroids)
            label = d.argmin(1).astype(np.int32) if len(y) else np.zeros(0, np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))
            lists = pa.array([None if b else v for b, v in zip(bad, lists.to_pylist())], pa.list_(pa.float64())) if bad.any() else lists
            dist = np.sqrt(d[np.arange(len(d)), label])
            return pa.StructArray.from_arrays([lists, pa.array(label, mask=bad), pa.array(dist, mask=bad)], ["reduced", "label_id", "dist"])

        return songs.withColumn("_placed", placed("embedding")).select(
            *[c for c in songs.columns if c not in ("reduced", "label_id", "dist")], "_placed.*")


def fit_song_model(songs: DataFrame, dims: int = 8, k: int = 8, n_init: int = STARTS, seed: int = 42) -> SongModel:
    """Scaler, principal components and K-means of ``songs (id, embedding)``, each fitted on what the one before gives."""
    songs = songs.filter(has_vector())
    scaler = sorted(scaler_fit(songs).collect(), key=lambda r: r["pos"])
    reduced, pca = reduce_dims(songs, dims)
    centroids, _ = kmeans_fit(reduced.select("id", F.col("reduced").alias("embedding")), k, n_init, seed)
    centres = sorted(centroids.collect(), key=lambda r: r["label_id"])
    return SongModel(np.array([r["mean"] for r in scaler]), np.array([r["std"] for r in scaler]), pca.pc.toArray().T,
                     np.array([r["centroid"] for r in centres]))
