"""The test tables in the roles the operators expect, and the same roles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.operators.centroids import centroids_of, mood_profiles
from arcloom.operators.graphs import scored_neighbours
from arcloom.operators.moods import mood_pools, pool_sizes
from arcloom.operators.playlist import NEAREST_KEPT, arc_positions, neighbour_table
from arcloom.plans.registry import shared

# The vectors are only weakly clustered; this sharpness puts mood scores on both sides of every bound.
SHARPNESS = 120.0
WALK_PRUNE = 0.2
LAST_DAY = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def songs(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("artist"),
        F.col("p_size").cast("double").alias("tempo"), (F.col("p_retailprice") / 2048).alias("energy"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    return vectors(spark, sf).join(part, "id", "left").join(docs, "id", "left").select(
        "id", "embedding", "label", F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("artist", F.lit("")).alias("artist"), F.coalesce("language", F.lit("en")).alias("language"),
        F.coalesce("tempo", F.lit(0.0)).alias("tempo"), F.coalesce("energy", F.lit(0.0)).alias("energy"),
        F.element_at("embedding", 1).alias("valence"), F.element_at("embedding", 2).alias("danceability"))


def centroids(spark, sf) -> DataFrame:
    return centroids_of(vectors(spark, sf))


def labels(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("label").alias("label_id")).distinct().withColumns(
        {"label": F.concat(F.lit("mood_"), F.col("label_id").cast("string")), "description": F.lit("")})


def profiles(spark, sf, sharpness: float = SHARPNESS) -> DataFrame:
    """Songs with mood scores; language and text columns ride along."""
    return mood_profiles(songs(spark, sf), centroids(spark, sf), sharpness)


def bare_profiles(spark, sf) -> DataFrame:
    """Mood scores from the vectors alone."""
    return mood_profiles(vectors(spark, sf), centroids(spark, sf), SHARPNESS)


def neighbours(spark, sf) -> DataFrame:
    scored = scored_neighbours(vectors(spark, sf), NEAREST_KEPT)
    return neighbour_table(scored, profiles(spark, sf), prune=WALK_PRUNE)


def pools(spark, sf):
    rows = mood_pools(profiles(spark, sf).select("id", "embedding", "language", "scores", "mood_ids"))
    return rows, pool_sizes(rows)


def requests(spark, sf) -> DataFrame:
    """One request per vector; arcs of one to three moods, some with a language."""
    wheel = F.array(*[F.concat(F.lit("mood_"), ((F.col("label") + s) % 10).cast("string")) for s in (0, 3, 7)])
    return vectors(spark, sf).select(
        F.col("id").alias("request_id"), F.col("id").alias("seed_id"),
        F.slice(wheel, 1, F.col("label") % 3 + 1).alias("arc"), (F.lit(0.05) + F.col("label") * 0.1).alias("temperature"),
        (F.lit(5) + F.col("label")).cast("int").alias("playlist_len"),
        F.when(F.col("label") % 2 == 1, F.lit("en")).alias("wanted"))


def placed_requests(spark, sf) -> DataFrame:
    return arc_positions(requests(spark, sf), labels(spark, sf))


def states(spark, sf) -> DataFrame:
    """Every song as the current song of a request that wants the next two moods on the wheel."""
    return vectors(spark, sf).select(
        F.col("id").alias("request_id"), F.col("id").alias("current"), ((F.col("label") + 1) % 10).cast("int").alias("mood"),
        ((F.col("label") + 2) % 10).cast("int").alias("next_mood"), F.array("id").alias("played"),
        F.when(F.col("label") % 2 == 1, F.lit("en")).alias("wanted"))


def extraction(spark, sf) -> DataFrame:
    """Documents as songs in extraction: unlabelled pending, toxic failed, other done."""
    marks = table(spark, sf, "labels").select("doc_id", "toxic")
    return table(spark, sf, "documents").join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("source").alias("genre"), "n_chars",
        F.when(F.col("toxic") == 0, F.to_timestamp(F.lit(LAST_DAY))).alias("processed_at"),
        F.when(F.col("toxic") == 1, F.lit("ToxicError: flagged")).alias("extraction_error"))


def catalog(spark, sf) -> DataFrame:
    """Documents as a raw catalogue with missing and blank values."""
    marks = table(spark, sf, "labels")
    return table(spark, sf, "documents").join(marks, "doc_id", "left").select(
        F.when(F.col("toxic") == 1, F.lit("  ")).otherwise(
            F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" "))).alias("track_id"),
        F.col("text").alias("track_name"), F.when(F.col("quality").isNotNull(), F.col("source")).alias("artists"),
        F.when(F.col("quality") == 1, F.col("lang")).alias("album_name"),
        F.when(F.col("quality") == 1, F.col("n_chars")).alias("duration_ms"), F.col("source").alias("track_genre"),
        F.col("doc_id").alias("ord"))


def predictions(spark, sf) -> DataFrame:
    from arcloom.functions.hashing import uniform

    return table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("label"), F.round(uniform("score", "doc_id"), 3).alias("score"))


shared("songs", """
 SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS emb, e.label, coalesce(p.p_name, '') AS name,
  coalesce(p.p_brand, '') AS artist, coalesce(d.lang, 'en') AS language, coalesce(p.p_size, 0)::DOUBLE AS tempo,
  coalesce(p.p_retailprice / 2048, 0) AS energy, (e.embedding::DOUBLE[])[1] AS valence, (e.embedding::DOUBLE[])[2] AS danceability
 FROM embeddings e LEFT JOIN part p ON p.p_partkey = e.vec_id LEFT JOIN documents d ON d.doc_id = e.vec_id""")
shared("cells", """
 SELECT s.id, s.label, t.i AS pos, s.emb[t.i] AS x FROM songs s, (SELECT unnest(range(1, 65)) AS i) t""", ("songs",))
shared("cents", """
 SELECT label AS label_id, list(m ORDER BY pos) AS c
 FROM (SELECT label, pos, avg(x) AS m FROM cells GROUP BY label, pos) GROUP BY label""", ("cells",))
shared("dists", """
 SELECT s.id, c.label_id, list_distance(s.emb, c.c) AS dist FROM songs s CROSS JOIN cents c""", ("songs", "cents"))
shared("moods", """
 SELECT id, label_id, round(e / sum(e) OVER (PARTITION BY id), 4) AS score FROM (
  SELECT id, label_id, exp(-120 * (dist - min(dist) OVER (PARTITION BY id))) AS e FROM dists)""", ("dists",))
shared("ranked", """
 SELECT id, label_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, label_id) - 1 AS rank,
  max(score) OVER (PARTITION BY id) AS top FROM moods""", ("moods",))
shared("idx", """
 SELECT id, label_id AS mood, rank, score FROM ranked
 WHERE (rank = 0 AND score >= 0.30) OR (rank = 1 AND score >= 0.40 AND score >= 0.85 * top)""", ("ranked",))
shared("nn", """
 SELECT src, dst, rank, dist, cosine FROM (
  SELECT a.id AS src, b.id AS dst, round(list_distance(a.emb, b.emb), 6) AS dist,
   list_dot_product(a.emb, b.emb) / ((sqrt(list_dot_product(a.emb, a.emb)) + 1e-8) * (sqrt(list_dot_product(b.emb, b.emb)) + 1e-8)) AS cosine,
   row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.emb, b.emb), 6), b.id) AS rank
  FROM songs a JOIN songs b ON a.id <> b.id) WHERE rank <= 179""", ("songs",))
shared("edges", """
 SELECT src, dst, rank, dist, round(cosine, 4) AS score FROM nn WHERE rank <= 50 AND cosine >= 0.2""", ("nn",))
shared("sims", """
 SELECT a.label_id AS i, b.label_id AS j, 1 - list_distance(a.c, b.c) / (
  (SELECT max(list_distance(x.c, y.c)) FROM cents x, cents y) + 1e-8) AS sim
 FROM cents a JOIN cents b ON a.label_id < b.label_id""", ("cents",))
shared("names", "SELECT DISTINCT label AS label_id, 'mood_' || label AS label FROM embeddings")
shared("states", """
 SELECT id AS request_id, id AS current, (label + 1) % 10 AS mood, (label + 2) % 10 AS next_mood,
  CASE WHEN label % 2 = 1 THEN 'en' END AS wanted FROM songs""", ("songs",))
shared("near", """
 SELECT t.request_id, t.mood, t.next_mood, t.wanted, n.dst AS id, n.rank, n.cosine AS direct,
  CASE WHEN n.rank <= 50 AND n.cosine >= 0.2 THEN round(n.cosine, 4) END AS graph_score, s.language,
  m.score AS mood_score, m2.score AS next_score
 FROM states t JOIN nn n ON n.src = t.current JOIN songs s ON s.id = n.dst
 JOIN moods m ON m.id = n.dst AND m.label_id = t.mood JOIN moods m2 ON m2.id = n.dst AND m2.label_id = t.next_mood""",
       ("states", "nn", "moods"))
shared("pools", """
 SELECT mood, id, row_number() OVER (PARTITION BY mood ORDER BY md5('pool|' || id), id) - 1 AS pos,
  count(*) OVER (PARTITION BY mood) AS n FROM idx""", ("idx",))
shared("preds", """
 SELECT doc_id, quality AS label, round(('0x' || substr(md5('score|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0, 3) AS score
 FROM labels""")
shared("requests", """
 SELECT id AS request_id, id AS seed_id, list_slice(['mood_' || label, 'mood_' || ((label + 3) % 10), 'mood_' || ((label + 7) % 10)],
  1, label % 3 + 1) AS arc, list_slice([label, (label + 3) % 10, (label + 7) % 10], 1, label % 3 + 1) AS spots,
  0.05 + label * 0.1::DOUBLE AS temperature, (5 + label)::INTEGER AS playlist_len, CASE WHEN label % 2 = 1 THEN 'en' END AS wanted
 FROM songs""", ("songs",))
shared("extraction", """
 SELECT d.doc_id AS id, d.lang AS language, d.source AS genre, d.n_chars,
  CASE WHEN l.toxic = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS processed_at,
  CASE WHEN l.toxic = 1 THEN 'ToxicError: flagged' END AS extraction_error
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
shared("catalog", """
 SELECT CASE WHEN l.toxic = 1 THEN '  ' ELSE ' ' || d.doc_id || ' ' END AS track_id, d.text AS track_name,
  CASE WHEN l.quality IS NOT NULL THEN d.source END AS artists, CASE WHEN l.quality = 1 THEN d.lang END AS album_name,
  CASE WHEN l.quality = 1 THEN d.n_chars END AS duration_ms, d.source AS track_genre, d.doc_id AS ord
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
