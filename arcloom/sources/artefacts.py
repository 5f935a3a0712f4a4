"""Saving and loading fitted state."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from arcloom.sources.workspace import new_path


def save_model(model, spark: SparkSession, name: str) -> str:
    path = new_path(spark, name)
    model.write().overwrite().save(path)
    return path


def load_transition_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_scaler(scaler: DataFrame, name: str = "scaler") -> DataFrame:
    """Scaler state is a small table ``(pos, mean, std)``."""
    path = new_path(scaler.sparkSession, name)
    scaler.write.parquet(path)
    return scaler.sparkSession.read.schema(scaler.schema).parquet(path)
