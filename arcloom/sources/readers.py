"""Scans. Column pruning and filters are left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcloom.schemas import CATALOG


def scan_catalog_csv(spark: SparkSession, path: str, schema: T.StructType = CATALOG) -> DataFrame:
    """Header CSV with a declared schema, so that no inference pass reads the file."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=False, escape='"')


def scan_csv_pruned(spark: SparkSession, path: str, key: str, genre: str, schema=CATALOG) -> DataFrame:
    """Key and genre only; rows without either are dropped and the key is trimmed."""
    return (
        scan_catalog_csv(spark, path, schema).select(key, genre).dropna(subset=[key, genre])
        .withColumn(key, F.trim(F.col(key).cast("string")))
    )


def scan_vectors(spark: SparkSession, path: str, id_col="id", vector_col="embedding", metadata=()) -> DataFrame:
    """Ids, vectors as doubles and the metadata columns asked for."""
    return spark.read.parquet(path).select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), *metadata)


def lookup_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is listed; unknown keys are silently absent. Spark picks the join by size."""
    return df.join(ids.select(key), key, "left_semi")
