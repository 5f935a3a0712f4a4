"""Feature tables: joins, metadata packing, scaling and projection."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.functions.vectors import as_doubles, pack


def feature_scan_join(features: DataFrame, songs: DataFrame) -> DataFrame:
    """Features with their song's text columns, ordered by id."""
    return features.join(songs, features["song_id"] == songs["id"]).drop("id").orderBy("song_id")


def full_metadata_join(features: DataFrame, songs: DataFrame, moods: DataFrame, clusters: DataFrame) -> DataFrame:
    """Features and song columns, plus cluster, label and mood JSON where known."""
    named = moods.join(clusters.select(F.col("label_id").alias("cluster_id"), "label"), "cluster_id", "left")
    return (
        features.join(songs.withColumnRenamed("id", "song_id"), "song_id").join(named, "song_id", "left")
        .withColumns({
            "album": F.coalesce("album", F.lit("")), "language": F.coalesce("language", F.lit("en")),
            "mood_scores": F.coalesce("mood_scores", F.lit("{}")), "cluster_label": F.coalesce("label", F.lit("")),
        }).drop("label")
    )


def features_default_zero(songs: DataFrame, features: DataFrame, names) -> DataFrame:
    """Every song with the named features, absent ones as 0."""
    return songs.join(features.withColumnRenamed("song_id", "id").select("id", *names), "id", "left").select(
        *songs.columns, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])


def pack_metadata(df: DataFrame, text_cols, names) -> DataFrame:
    """Flat metadata row plus ``features_json`` holding the named features."""
    return df.select("id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in text_cols],
                     F.to_json(F.struct(*names)).alias("features_json"))


def scaler_fit(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(pos, mean, std)`` per dimension; population deviation, 1 where it is zero.

    One pass over packed vectors with partial summaries; nothing is exploded per cell.
    """
    v = array_to_vector(as_doubles(vector))
    n = F.col("n").cast("double")
    return (
        df.agg(Summarizer.mean(v).alias("m"), Summarizer.variance(v).alias("s"), F.count(F.lit(1)).alias("n"))
        .select("n", F.posexplode(F.arrays_zip(vector_to_array("m").alias("mean"), vector_to_array("s").alias("var"))))
        .select("pos", F.col("col.mean").alias("mean"), F.sqrt(F.col("col.var") * (n - 1) / n).alias("raw"))
        .select("pos", "mean", F.when(F.col("raw") > 0, F.col("raw")).otherwise(1.0).alias("std"))
    )


def scaler_transform(df: DataFrame, scaler: DataFrame, vector: str = "embedding", out: str = "scaled") -> DataFrame:
    """Standardised vectors. The scaler has one row per dimension and enters the plan as literals."""
    rows = sorted(scaler.collect(), key=lambda r: r["pos"])
    means, stds = (F.array(*[F.lit(float(r[c])) for r in rows]) for c in ("mean", "std"))
    centred = F.zip_with(as_doubles(vector), means, lambda x, m: x - m)
    return df.withColumn(out, F.zip_with(centred, stds, lambda x, s: x / s))


def embedding_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean, deviation, minimum and maximum over all cells and the mean per-dimension deviation."""
    v = array_to_vector(as_doubles(vector))
    n = F.col("n").cast("double")
    per_dim = (
        df.agg(Summarizer.mean(v).alias("m"), Summarizer.variance(v).alias("s"), Summarizer.min(v).alias("lo"),
               Summarizer.max(v).alias("hi"), F.count(F.lit(1)).alias("n"))
        .select("n", F.explode(F.arrays_zip(
            vector_to_array("m").alias("mean"), vector_to_array("s").alias("var"),
            vector_to_array("lo").alias("lo"), vector_to_array("hi").alias("hi"))).alias("d"))
        .select("d.*", (F.col("d.var") * (n - 1) / n).alias("pop"))
    )
    mean = F.avg("mean")
    return per_dim.agg(
        mean.alias("mean"), F.sqrt(F.avg(F.col("pop") + F.col("mean") * F.col("mean")) - mean * mean).alias("std"),
        F.min("lo").alias("min"), F.max("hi").alias("max"), F.avg(F.sqrt("pop")).alias("mean_dim_std"))


def reduce_dims(df: DataFrame, k: int, vector: str = "embedding", out: str = "reduced"):
    """Linear projection of standardised vectors on ``k`` principal components: (frame, model)."""
    scaled = scaler_transform(df, scaler_fit(df, vector), vector).withColumn("_v", array_to_vector("scaled"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(scaled)
    return model.transform(scaled).withColumn(out, vector_to_array("_p")).drop("_v", "_p", "scaled"), model


def pair_features(pairs: DataFrame, songs: DataFrame) -> DataFrame:
    """Pairs plus ``features``: both vectors, the B-A differences of three features, both mood arrays."""
    def side(tag):
        return songs.select(F.col("id").alias(tag), F.struct(
            as_doubles("embedding").alias("emb"), pack(["tempo", "energy", "valence"]).alias("feat"),
            F.col("scores").alias("moods")).alias(f"_{tag}"))

    delta = F.zip_with("_b.feat", "_a.feat", lambda x, y: x - y)
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn(
        "features", F.concat("_a.emb", "_b.emb", delta, "_a.moods", "_b.moods")).drop("_a", "_b")
