"""Track summaries from frame, chroma, beat and spectrum tables.

All of them are algebraic aggregates, combined before the shuffle, so a long track is no hot spot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.schemas import FEATURES

# Chroma bins of the two chord templates, the low band in Hz, the tempo bounds.
MAJOR_BINS, MINOR_BINS = [0, 4, 7], [0, 3, 7]
LOW_BAND_HZ = 500
EPS = 1e-6


def frame_summary(frames: DataFrame, names, mfcc: str | None = None, mfcc_bin: str | None = None,
                  energy: str = "rms") -> DataFrame:
    """Mean of each frame feature and population deviation of the energy, per track.

    A long-form coefficient column becomes ``mfcc_1..13`` by conditional means.
    """
    parts = [F.avg(n).alias(f"{n}_mean") for n in names] + [F.stddev_pop(energy).alias(f"{energy}_std")]
    if mfcc is not None:
        parts += [F.avg(F.when(F.col(mfcc_bin) == i, F.col(mfcc))).alias(f"mfcc_{i + 1}") for i in range(13)]
    return frames.groupBy("track").agg(*parts)


def chroma_summary(chroma: DataFrame) -> DataFrame:
    return chroma.groupBy("track").agg(F.avg("value").alias("chroma_mean"), F.stddev_pop("value").alias("chroma_std"))


def fix_tempo_octave(tempo: Column, energy: Column, rule: str = "current") -> Column:
    """Undo double- and half-time detection. ``legacy`` doubles below 60 whatever the energy."""
    slow = tempo < 60 if rule == "legacy" else (tempo < 90) & (energy > 0.20)
    return F.when((tempo > 150) & (energy <= 0.25), tempo / 2).when(slow, tempo * 2).otherwise(tempo)


def _bin_means(bin_: str, value: str) -> list[Column]:
    return [F.avg(F.when(F.col(bin_) == b, F.col(value))).alias(f"b{b}") for b in sorted({*MAJOR_BINS, *MINOR_BINS})]


def _valence() -> Column:
    """From the bin means ``b0`` and so on; a chord without a known bin has strength 0."""
    def strength(bins):
        known = F.filter(F.array(*[f"b{b}" for b in bins]), lambda x: x.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)

    raw = (strength(MAJOR_BINS) - strength(MINOR_BINS) + 1) / 2
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def valence_proxy(chroma: DataFrame) -> DataFrame:
    """Major against minor chord strength, mapped to [0, 1]."""
    return chroma.groupBy("track").agg(*_bin_means("bin", "value")).select("track", _valence().alias("valence_proxy"))


def _beat_gaps(beats: DataFrame, span_seconds: int) -> DataFrame:
    """``(track, gap)`` for all consecutive beats.

    Beats are cut into time spans, so no track is ordered in one task: the intervals inside a span come
    from a window, the one across spans from each span's first and last beat.
    """
    spans = beats.withColumn("_span", F.floor(F.col("beat_time") / span_seconds))
    inside = Window.partitionBy("track", "_span").orderBy("beat_time")
    gaps = spans.withColumn("gap", F.col("beat_time") - F.lag("beat_time").over(inside)).filter("gap is not null")
    ends = spans.groupBy("track", "_span").agg(F.min("beat_time").alias("lo"), F.max("beat_time").alias("hi"))
    across = ends.withColumn(
        "gap", F.col("lo") - F.lag("hi").over(Window.partitionBy("track").orderBy("_span"))).filter("gap is not null")
    return gaps.select("track", "gap").unionByName(across.select("track", "gap"))


def _regularity(mean: str, deviation: str) -> Column:
    raw = F.lit(1.0) - F.col(deviation) / (F.col(mean) + F.lit(EPS))
    return F.when(F.col(mean).isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def danceability_proxy(beats: DataFrame, span_seconds: int = 3600) -> DataFrame:
    """Regularity of the beat intervals; 0 for a track with at most one beat."""
    stats = _beat_gaps(beats, span_seconds).groupBy("track").agg(F.stddev_pop("gap").alias("s"), F.avg("gap").alias("m"))
    return beats.select("track").distinct().join(stats, "track", "left").select("track", _regularity("m", "s").alias("danceability_proxy"))


def acousticness_proxy(spectrum: DataFrame) -> DataFrame:
    """Share of the mean magnitude that lies below 500 Hz."""
    low = F.avg(F.when(F.col("freq") < LOW_BAND_HZ, F.col("magnitude")))
    high = F.avg(F.when(F.col("freq") >= LOW_BAND_HZ, F.col("magnitude")))
    sums = spectrum.groupBy("track").agg(F.coalesce(low, F.lit(0.0)).alias("lo"), F.coalesce(high, F.lit(0.0)).alias("hi"))
    return sums.select("track", (F.col("lo") / (F.col("lo") + F.col("hi") + F.lit(EPS))).alias("acousticness_proxy"))


# Columns of the frame table and the features that are their means.
FRAME_MEANS = {"rms": "energy_mean", "centroid": "spectral_centroid", "bandwidth": "spectral_bandwidth",
               "rolloff": "spectral_rolloff", "contrast": "spectral_contrast", "zcr": "zcr"}


def feature_rows(tempos: DataFrame, frames: DataFrame, coefficients: DataFrame, chroma: DataFrame, beats: DataFrame,
                 spectrum: DataFrame, rule: str = "current", span_seconds: int = 3600) -> DataFrame:
    """``track`` and the 26 features in storage order, one row for each track of any table.

    ``tempos (track, tempo)``, ``frames (track, rms, centroid, bandwidth, rolloff, contrast, zcr)``, ``coefficients (track, bin, value)``
    with bins from 0, ``chroma (track, bin, value)``, ``beats (track, beat_time)``, ``spectrum (track, freq, magnitude)``.
    The tables meet in one aggregate whose partial sums are all that is shuffled by track; only the beats are ordered before, by track and
    time span. Null values and values without a bin or frequency are left out of the sums; a null track is a track; repeated rows count as often as they
    stand there, but beats at one time are intervals of 0. What a track has no values for is null, except the danceability of a track with at
    most one beat, which is 0. An uncorrected tempo stays where the energy is unknown. Other columns are ignored.
    """
    parts = [
        tempos.select("track", F.col("tempo").cast("double").alias("tempo")),
        frames.select("track", *[F.col(c).cast("double").alias(c) for c in FRAME_MEANS]),
        coefficients.select("track", F.col("bin").alias("coef"), F.col("value").cast("double").alias("mfcc")),
        chroma.select("track", "bin", F.col("value").cast("double").alias("chroma")),
        spectrum.select("track", F.col("freq").cast("double").alias("freq"), F.col("magnitude").cast("double").alias("magnitude")),
        beats.select("track"),
        _beat_gaps(beats.select("track", F.col("beat_time").cast("double").alias("beat_time")).filter("beat_time is not null"), span_seconds),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    low, high = F.col("freq") < LOW_BAND_HZ, F.col("freq") >= LOW_BAND_HZ
    sums = rows.groupBy("track").agg(
        F.avg("tempo").alias("_tempo"), *[F.avg(c).alias(n) for c, n in FRAME_MEANS.items()], F.stddev_pop("rms").alias("energy_std"),
        F.avg("chroma").alias("chroma_mean"), F.stddev_pop("chroma").alias("chroma_std"), *_bin_means("bin", "chroma"),
        F.avg("gap").alias("_gap"), F.stddev_pop("gap").alias("_gap_std"),
        F.avg(F.when(low, F.col("magnitude"))).alias("_low"), F.avg(F.when(high, F.col("magnitude"))).alias("_high"),
        *[F.avg(F.when(F.col("coef") == i, F.col("mfcc"))).alias(f"mfcc_{i + 1}") for i in range(13)])
    lo, hi = F.coalesce("_low", F.lit(0.0)), F.coalesce("_high", F.lit(0.0))
    return sums.withColumns({
        "tempo": fix_tempo_octave(F.col("_tempo"), F.col("energy_mean"), rule),
        "valence_proxy": F.when(F.col("chroma_mean").isNotNull(), _valence()),
        "danceability_proxy": _regularity("_gap", "_gap_std"),
        "acousticness_proxy": F.when(F.col("_low").isNotNull() | F.col("_high").isNotNull(), lo / (lo + hi + F.lit(EPS))),
    }).select("track", *FEATURES)
