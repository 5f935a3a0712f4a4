"""Fixed table schemas."""

from pyspark.sql import types as T

# The feature columns of a song, in storage order.
NAMED_FEATURES = [
    "tempo", "energy_mean", "energy_std", "valence_proxy", "danceability_proxy", "acousticness_proxy",
    "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_contrast", "zcr",
    "chroma_mean", "chroma_std",
]
FEATURES = NAMED_FEATURES + [f"mfcc_{i}" for i in range(1, 14)]

CATALOG = T.StructType([
    T.StructField("track_id", T.StringType()),
    T.StructField("track_name", T.StringType()),
    T.StructField("artists", T.StringType()),
    T.StructField("album_name", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("track_genre", T.StringType()),
])
