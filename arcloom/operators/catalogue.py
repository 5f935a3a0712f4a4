"""Cleaning, projecting, sampling and counting the song catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.operators.positions import hash_positions, with_positions
from arcloom.sources.workspace import store

# Genre to language.
GENRE_LANGUAGE = {
    "indian": "hi",
    "cantopop": "zh", "mandopop": "zh",
    "j-pop": "ja", "j-rock": "ja", "j-dance": "ja", "j-idol": "ja", "anime": "ja",
    "k-pop": "ko",
    "french": "fr", "german": "de", "swedish": "sv",
    "spanish": "es", "latin": "es", "latino": "es",
    "brazil": "pt", "forro": "pt", "samba": "pt", "pagode": "pt", "sertanejo": "pt", "mpb": "pt",
    "turkish": "tr", "iranian": "fa", "malay": "ms",
    "tango": "es", "salsa": "es", "reggaeton": "es",
}
URI_PREFIX = "spotify:track:"
TRACK_ID_PATTERN = "^[A-Za-z0-9]+$"
POSITION_SPAN = 10_000
BLANKS = " \t\n\r\x0b\x0c"


def strip(col) -> Column:
    """Trim spaces, tabs and line breaks."""
    return F.trim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def clean_catalog(df: DataFrame) -> DataFrame:
    """Rows with an id that is not blank, a name and an artist."""
    return df.dropna(subset=["track_id", "track_name", "artists"]).filter(strip("track_id") != "")


def dedup_first(df: DataFrame, key, order: str) -> DataFrame:
    """First row per key in file order. Spark limits each group to one row before the shuffle too."""
    first = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def project_catalog(df: DataFrame, uri_prefix: str = URI_PREFIX) -> DataFrame:
    """Catalogue rows in the shape of the songs table."""
    key = strip("track_id")
    return df.select(
        key.alias("id"), strip("track_name").alias("name"), strip("artists").alias("artist"),
        F.coalesce(strip("album_name"), F.lit("")).alias("album"), F.lit(0).alias("year"),
        F.coalesce(F.col("duration_ms").cast("long"), F.lit(0)).alias("duration_ms"),
        F.concat(F.lit(uri_prefix), key).alias("uri"),
    )


def infer_language(genre: str | Column) -> Column:
    genre = F.col(genre) if isinstance(genre, str) else genre
    pairs = [F.lit(x) for item in GENRE_LANGUAGE.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), strip(F.lower(genre))), F.lit("en"))


def stratified_sample(df: DataFrame, stratum: str, size: int, seed, keys) -> DataFrame:
    """An equal random share of each stratum, at least one row; all rows if there are no more than ``size``."""
    total = df.agg(F.count("*")).scalar()
    share = F.greatest(F.lit(1), F.floor(F.lit(size) / F.greatest(df.agg(F.count_distinct(stratum)).scalar(), F.lit(1))))
    quota = F.when(total <= size, F.col("pos_n")).otherwise(share)
    drawn = hash_positions(df.filter(F.col(stratum).isNotNull()), seed, keys, groups=[stratum], quota=quota)
    rest = df.filter(F.col(stratum).isNull() & (total <= size))
    return drawn.drop("pos", "pos_n").unionByName(rest)


def uniform_sample(df: DataFrame, size: int, seed, keys) -> DataFrame:
    """``size`` random rows."""
    return hash_positions(df, seed, keys, quota=F.lit(size)).drop("pos", "pos_n")


def sample_topup(df: DataFrame, sampled: DataFrame, size: int, seed, keys) -> DataFrame:
    """``sampled`` filled up at random from the other rows of ``df``; never more than ``size`` rows."""
    sampled = store(sampled, "sample")
    have = sampled.agg(F.count("*")).scalar()
    rest = df.join(sampled.select(*keys), list(keys), "left_anti")
    fill = hash_positions(rest, seed, keys, quota=F.lit(size) - have).drop("pos", "pos_n")
    kept = hash_positions(sampled, seed, keys, quota=F.lit(size)).drop("pos", "pos_n")
    return kept.unionByName(fill)


def pending_rows(songs: DataFrame, order: str, limit: int = 0) -> DataFrame:
    """Rows neither processed nor failed, in insertion order; ``limit=0`` means all."""
    todo = songs.filter(F.col("processed_at").isNull() & F.col("extraction_error").isNull())
    return todo.orderBy(order).limit(limit) if limit else todo.orderBy(order)


def capture_errors(results: DataFrame, message_chars: int | None = None, text_chars: int | None = None) -> DataFrame:
    """``extraction_error`` as ``Type: message``; message and text are whole unless lengths are given."""
    def cut(text, chars):
        return text if chars is None else F.substring(text, 1, chars)

    message = cut(F.coalesce("error_message", F.lit("")), message_chars)
    text = cut(F.concat(F.col("error_type"), F.lit(": "), message), text_chars)
    return results.withColumn("extraction_error", text).drop("error_type", "error_message")


def filter_language(df: DataFrame, language: str | None) -> DataFrame:
    return df if language is None else df.filter(F.coalesce("language", F.lit("en")) == language)


def patch_genre_language(songs: DataFrame, catalog: DataFrame, key: str, genre: str, order: str) -> DataFrame:
    """Genre of the last catalogue row of each key and the language it implies."""
    last = (
        catalog.filter(F.col(genre).isNotNull()).groupBy(F.col(key).alias("id"))
        .agg(F.max_by(genre, order).alias("genre"))
    )
    return songs.drop("genre", "language").join(last, "id", "left").withColumns({
        "language": F.when(F.col("genre").isNull(), F.lit("en")).otherwise(infer_language("genre")),
        "genre": F.coalesce("genre", F.lit("unknown")),
    })


def extraction_status(songs: DataFrame) -> DataFrame:
    done, failed = F.col("processed_at").isNotNull(), F.col("extraction_error").isNotNull()
    return songs.agg(
        F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(failed).alias("failed"),
        F.count_if(~done & ~failed).alias("pending"))


def language_distribution(songs: DataFrame) -> DataFrame:
    return (
        songs.groupBy(F.coalesce("language", F.lit("en")).alias("language")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "language")
    )


def collection_counts(songs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Songs and moods on offer; the mood list is as long as the cluster table."""
    moods = clusters.agg(F.count("*").alias("moods"), F.array_sort(F.collect_list("label")).alias("labels"))
    return songs.agg(F.count("*").alias("songs")).select(
        "songs", moods.select("moods").scalar().alias("moods"),
        F.array_join(moods.select("labels").scalar(), ",").alias("labels"))


def split_track_ids(playlist: DataFrame, batch: int = 100, uri_prefix: str = URI_PREFIX) -> DataFrame:
    """Valid ids as URIs numbered in batches per request; others are marked as skipped."""
    valid = F.coalesce(F.col("id").rlike(TRACK_ID_PATTERN), F.lit(False))
    numbered = with_positions(playlist.withColumn("valid", valid), bucket=F.floor(F.col("pos") / POSITION_SPAN),
                              order=["pos"], groups=["request_id", "valid"], out="nth")
    return numbered.select(
        "request_id", "pos", "id", "valid",
        F.when(F.col("valid"), F.concat(F.lit(uri_prefix), F.col("id"))).alias("uri"),
        F.when(F.col("valid"), F.floor(F.col("nth") / batch)).alias("batch_no"))


def random_order(df: DataFrame, seed, keys, out: str = "row_id") -> DataFrame:
    """Number all rows in a seeded random order."""
    return hash_positions(df, seed, keys, out=out).drop(f"{out}_n")


def train_val_test_split(df: DataFrame, seed, keys, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Random 80/10/10 split with floor counts, in column ``split``."""
    n = F.col("pos_n")
    n_train, n_val = F.floor(n * train), F.floor(n * val)
    return hash_positions(df, seed, keys).withColumn(
        "split", F.when(F.col("pos") < n_train, "train").when(F.col("pos") < n_train + n_val, "val").otherwise("test")
    ).drop("pos", "pos_n")


def first_in_order(df: DataFrame, order: str, n: int, span: int) -> DataFrame:
    """The first ``n`` rows by an integer column with values in [0, span)."""
    width = max(1, span // 4096)
    return with_positions(df, bucket=F.floor(F.col(order) / width), order=[order], quota=F.lit(n)).drop("pos", "pos_n")
