"""Queries on sources, sinks, the catalogue and its joins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcloom.functions import moods as M
from arcloom.functions.vectors import dot, l2_distance, tidy
from arcloom.operators import catalogue as C
from arcloom.operators import centroids as K
from arcloom.operators import enrichment as E
from arcloom.operators import features as X
from arcloom.operators import graphs as G
from arcloom.operators import moods as O
from arcloom.operators import playlist as P
from arcloom.operators import search as S
from arcloom.operators.song_model import SongModel, fit_song_model
from arcloom.operators.transition import transition_band
from arcloom.plans import fixtures as fx
from arcloom.plans.registry import query
from arcloom.sources import readers, tables
from arcloom.sources.workspace import new_path, store

BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
SAMPLE_SIZE = 300


# --- sources and sinks ---------------------------------------------------------------------------

def _catalog_csv(spark, sf):
    path = new_path(spark, "catalog-csv")
    fx.table(spark, sf, "documents").select(
        F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("track_id"), F.col("source").alias("track_name"),
        F.col("source").alias("artists"), F.col("lang").alias("album_name"), F.col("n_chars").alias("duration_ms"),
        F.when(F.col("lang") != "de", F.col("source")).alias("track_genre"),
    ).write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return path


@query("scan_catalog_csv", """
 SELECT ' ' || doc_id AS track_id, source AS track_name, source AS artists, lang AS album_name, n_chars AS duration_ms,
  CASE WHEN lang <> 'de' THEN source END AS track_genre FROM documents""")
def scan_catalog_csv(spark, sf):
    return readers.scan_catalog_csv(spark, _catalog_csv(spark, sf))


@query("scan_csv_pruned", "SELECT doc_id::VARCHAR AS track_id, source AS track_genre FROM documents WHERE lang <> 'de'")
def scan_csv_pruned(spark, sf):
    return readers.scan_csv_pruned(spark, _catalog_csv(spark, sf), "track_id", "track_genre")


@query("scan_vectors", "SELECT id, (pos - 1)::INTEGER AS pos, round(x, 6) + 0.0 AS x FROM cells", ("cells",))
def scan_vectors(spark, sf):
    vectors = readers.scan_vectors(spark, f"{sf}/embeddings.parquet", id_col="vec_id")
    return vectors.select("id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", tidy(F.col("x"), 6))


@query("lookup_by_ids", "SELECT id, name, language FROM songs WHERE id IN (SELECT doc_id FROM labels)", ("songs",))
def lookup_by_ids(spark, sf):
    ids = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return readers.lookup_by_ids(fx.songs(spark, sf), ids).select("id", "name", "language")


@query("append_new_rows", """
 WITH old AS (SELECT d.doc_id, d.text FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
 SELECT doc_id, md5(text) AS key, false AS inserted FROM old UNION ALL
 SELECT min(doc_id), md5(text), true FROM documents WHERE text NOT IN (SELECT text FROM old) GROUP BY text""")
def append_new_rows(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    old = docs.join(fx.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return tables.append_new_rows(old, docs, "text", ["doc_id"]).select("doc_id", F.md5("text").alias("key"), "inserted")


@query("upsert_features", """
 WITH last AS (SELECT l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey
   ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1)
 SELECT p.p_partkey AS song_id, coalesce(l.l_quantity, p.p_size) AS tempo,
  CASE WHEN l.l_partkey IS NOT NULL THEN '2024-01-01' END AS stamped FROM part p LEFT JOIN last l ON l.l_partkey = p.p_partkey
 UNION ALL SELECT l_partkey, l_quantity, '2024-01-01' FROM last WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""")
def upsert_features(spark, sf):
    old = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("song_id"), F.col("p_size").cast("double").alias("tempo"))
    new = fx.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("song_id"), F.col("l_quantity").alias("tempo"), "l_shipdate", "l_orderkey", "l_linenumber")
    order = [F.desc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "tempo")]
    merged = tables.upsert_features(old, new, "song_id", F.to_timestamp(F.lit(fx.LAST_DAY)), order)
    return merged.select("song_id", "tempo", F.date_format("processed_at", "yyyy-MM-dd").alias("stamped"))


@query("overwrite_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def overwrite_table(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return tables.overwrite_table(orders, "orders")


@query("update_metadata", """
 SELECT s.id, s.name, coalesce(CASE WHEN l.quality = 1 THEN 'q1' END, s.language) AS language, l.toxic
 FROM songs s LEFT JOIN labels l ON l.doc_id = s.id""", ("songs",))
def update_metadata(spark, sf):
    updates = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.lit("q1")).alias("language"), "toxic")
    return tables.update_metadata(fx.songs(spark, sf).select("id", "name", "language"), updates, "id")


def _edges(spark, sf, prune):
    return G.song_graph(G.scored_neighbours(fx.vectors(spark, sf), G.TOP_K), prune)


@query("export_adjacency", """
 SELECT s.id, coalesce(string_agg(e.dst || ':' || (e.score * 10000)::INTEGER, ' ' ORDER BY e.score DESC, e.dst), '') AS edges
 FROM songs s LEFT JOIN (SELECT src, dst, round(cosine, 4) AS score FROM nn WHERE rank <= 50 AND cosine >= 0.3) e ON e.src = s.id
 GROUP BY s.id""", ("nn",))
def export_adjacency(spark, sf):
    lists = tables.export_adjacency(fx.vectors(spark, sf), _edges(spark, sf, G.PRUNE_BELOW))
    text = F.transform("edges", lambda e: F.concat_ws(
        ":", e["target"].cast("string"), F.round(e["score"] * 10000).cast("int").cast("string")))
    return lists.select("id", F.array_join(text, " ").alias("edges"))


@query("import_adjacency", "SELECT src, dst, round(cosine, 4) + 0.0 AS score FROM nn WHERE rank <= 50 AND cosine >= 0.3", ("nn",))
def import_adjacency(spark, sf):
    return tables.import_adjacency(tables.export_adjacency(fx.vectors(spark, sf), _edges(spark, sf, G.PRUNE_BELOW)))


@query("write_playlists", "SELECT conv_id AS request_id, turn AS pos, role, text FROM conversations")
def write_playlists(spark, sf):
    rows = fx.table(spark, sf, "conversations").withColumnsRenamed({"conv_id": "request_id", "turn": "pos"})
    return tables.write_playlists(rows)


@query("playlist_json", """
 SELECT conv_id AS request_id, '[' || string_agg('{"pos":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS playlist
 FROM conversations GROUP BY conv_id""")
def playlist_json(spark, sf):
    rows = fx.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("pos"), "role")
    return tables.playlist_json(rows)


@query("model_save_load", "SELECT vec_id AS id, true AS agrees, 18 AS parameters FROM embeddings WHERE vec_id % 2 = 1")
def model_save_load(spark, sf):
    """Songs outside the fit, placed by the loaded model, against column arithmetic on its parameter table."""
    songs = fx.vectors(spark, sf).select("id", "embedding")
    path = fit_song_model(songs.filter("id % 2 = 0")).save(spark)
    model = SongModel.load(spark, path)
    rows = {name: [r["values"] for r in sorted(spark.read.parquet(path).filter(F.col("stage") == name).collect(), key=lambda r: r["pos"])]
            for name in ("mean", "std", "component", "centroid")}

    def literal(values):
        return F.array(*[F.lit(x) for x in values])

    scaled = F.zip_with(F.zip_with("embedding", literal(rows["mean"][0]), lambda x, m: x - m), literal(rows["std"][0]), lambda x, s: x / s)
    plain = store(model.place(songs.filter("id % 2 = 1")).withColumn("scaled", scaled), "placed-songs")
    plain = plain.withColumn("projected", F.array(*[dot(F.col("scaled"), literal(c)) for c in rows["component"]]))
    plain = plain.withColumn("distances", F.array(*[F.round(l2_distance(F.col("projected"), literal(c)), 9) for c in rows["centroid"]]))
    near = F.round("dist", 9) == F.array_min("distances")
    same = F.element_at("distances", F.col("label_id") + 1) == F.array_min("distances")
    return plain.select("id", (near & same).alias("agrees"), F.lit(sum(map(len, rows.values()))).alias("parameters"))


# --- projections, filters and lookups -------------------------------------------------------------

@query("clean_catalog", f"""
 SELECT ord, track_id, artists FROM catalog WHERE track_id IS NOT NULL AND track_name IS NOT NULL AND artists IS NOT NULL
  AND trim(track_id, {BLANKS_SQL}) <> ''""", ("catalog",))
def clean_catalog(spark, sf):
    return C.clean_catalog(fx.catalog(spark, sf)).select("ord", "track_id", "artists")


@query("project_catalog", f"""
 SELECT trim(track_id, {BLANKS_SQL}) AS id, trim(track_name, {BLANKS_SQL}) AS name, trim(artists, {BLANKS_SQL}) AS artist,
  coalesce(trim(album_name, {BLANKS_SQL}), '') AS album, 0 AS year, coalesce(duration_ms, 0)::BIGINT AS duration_ms,
  'spotify:track:' || trim(track_id, {BLANKS_SQL}) AS uri FROM catalog""", ("catalog",))
def project_catalog(spark, sf):
    return C.project_catalog(fx.catalog(spark, sf))


@query("infer_language", """
 SELECT doc_id, CASE lang WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' WHEN 'es' THEN 'es' ELSE
  CASE doc_id % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'pt' ELSE 'en' END END AS language FROM documents""")
def infer_language(spark, sf):
    other = F.when(F.col("doc_id") % 4 == 0, "k-pop").when(F.col("doc_id") % 4 == 1, "MPB").otherwise("rock")
    genre = F.when(F.col("lang") == "fr", " French ").when(F.col("lang") == "de", "german").when(
        F.col("lang") == "es", "Latino").otherwise(other)
    return fx.table(spark, sf, "documents").select("doc_id", C.infer_language(genre).alias("language"))


@query("pending_rows", """
 SELECT id, language, n_chars FROM extraction WHERE processed_at IS NULL AND extraction_error IS NULL""", ("extraction",))
def pending_rows(spark, sf):
    return C.pending_rows(fx.extraction(spark, sf), "id").select("id", "language", "n_chars")


SEARCH_SQL = """
 SELECT * FROM (
  SELECT q.query_id, row_number() OVER (PARTITION BY q.query_id ORDER BY s.id)::INTEGER AS rank, s.id, s.name, s.artist, r.label_id AS top_mood, f.profile
  FROM (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE substr(p_name, 3, 4) END AS text FROM part) q
  JOIN (SELECT p_partkey AS id, p_name AS name, p_type AS artist FROM part) s
   ON contains(lower(s.name), lower(q.text)) OR contains(lower(s.artist), lower(q.text))
  LEFT JOIN ranked r ON r.id = s.id AND r.rank = 0
  LEFT JOIN (SELECT id, string_agg(label_id || ':' || round(score * 10000)::BIGINT, ',' ORDER BY label_id) AS profile FROM moods GROUP BY id) f ON f.id = s.id)
 WHERE rank <= 10"""


def _search(spark, sf, kept: bool):
    part = fx.table(spark, sf, "part")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.when(
        F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.substring("p_name", 3, 4)).alias("text"))
    shelf = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("artist"))
    hits = S.search_text(asked, shelf, fx.bare_profiles(spark, sf), index=S.search_index(shelf) if kept else None)
    moods = F.transform(F.array_sort(F.map_entries("profile")), lambda m: F.concat(
        m["key"].cast("string"), F.lit(":"), F.round(m["value"] * 10000).cast("long").cast("string")))
    return hits.withColumn("profile", F.array_join(moods, ","))


@query("search_text", SEARCH_SQL, ("ranked",))
def search_text(spark, sf):
    return _search(spark, sf, kept=False)


@query("search_text_indexed", SEARCH_SQL, ("ranked",))
def search_text_indexed(spark, sf):
    return _search(spark, sf, kept=True)


@query("resolve_seed", """
 , q AS (SELECT p_partkey AS query_id, lower(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'x zz ' || p_type || ' ' || p_name END) AS text FROM part),
 st AS (SELECT query_id, text AS term, 0 AS word_pos, 1 AS stage FROM q UNION ALL SELECT query_id, text, 0, 2 FROM q UNION ALL
  SELECT query_id, w, p, 3 FROM (SELECT query_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM q) WHERE length(w) >= 2),
 terms AS (SELECT DISTINCT term FROM st),
 hits AS (SELECT t.term, min(s.id) FILTER (contains(lower(s.name), t.term)) AS by_name, min(s.id) FILTER (contains(lower(s.artist), t.term)) AS by_artist, min(s.id) AS by_any
  FROM terms t JOIN songs s ON contains(lower(s.name), t.term) OR contains(lower(s.artist), t.term) GROUP BY t.term),
 best AS (SELECT st.query_id, st.stage, CASE st.stage WHEN 1 THEN by_name WHEN 2 THEN by_artist ELSE by_any END AS id, st.word_pos
  FROM st JOIN hits USING (term) WHERE CASE st.stage WHEN 1 THEN by_name WHEN 2 THEN by_artist ELSE by_any END IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY st.query_id ORDER BY stage, word_pos, id) = 1)
 SELECT q.query_id, b.id, b.stage::INTEGER AS stage, b.id IS NOT NULL AS resolved FROM q LEFT JOIN best b USING (query_id)""", ("songs",))
def resolve_seed(spark, sf):
    third = F.concat(F.lit("x zz "), F.col("p_type"), F.lit(" "), F.col("p_name"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(third)
    asked = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), text.alias("text"))
    return S.resolve_seed(asked, fx.songs(spark, sf))


@query("resolve_seed_by_id", """
 SELECT c.c_custkey AS request_id, c.c_custkey AS seed_id, s.id IS NOT NULL AS resolved FROM customer c LEFT JOIN songs s ON s.id = c.c_custkey""", ("songs",))
def resolve_seed_by_id(spark, sf):
    asked = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("seed_id"))
    return S.resolve_seed_by_id(asked, fx.songs(spark, sf)).select("request_id", "seed_id", "resolved")


@query("filter_language", "SELECT id, language FROM songs WHERE language = 'en'", ("songs",))
def filter_language(spark, sf):
    return C.filter_language(fx.songs(spark, sf), "en").select("id", "language")


@query("validate_requests", """
 SELECT request_id, array_to_string(list_filter([
   CASE WHEN len(arc) = 0 THEN 'empty arc' END,
   CASE WHEN len(unknown) > 0 THEN 'unknown moods: ' || array_to_string(unknown, ',') END,
   CASE WHEN NOT temperature BETWEEN 0.05 AND 3.0 THEN 'temperature out of range' END,
   CASE WHEN NOT playlist_len BETWEEN 5 AND 50 THEN 'length out of range' END], lambda x: x IS NOT NULL), '; ') AS errors
 FROM (SELECT *, list_sort(list_distinct(list_filter(arc, lambda m: NOT list_contains(known, m)))) AS unknown FROM (
  SELECT c_custkey AS request_id, CASE WHEN c_mktsegment = 'BUILDING' THEN []::VARCHAR[] ELSE
   ['mood_' || (c_nationkey % 12), 'mood_' || (c_custkey % 11)] END AS arc, c_acctbal / 3000 AS temperature,
   c_nationkey * 3 AS playlist_len, known FROM customer, (SELECT list(label) AS known FROM names)))""", ("names",))
def validate_requests(spark, sf):
    arc = F.when(F.col("c_mktsegment") == "BUILDING", F.array().cast("array<string>")).otherwise(F.array(
        F.concat(F.lit("mood_"), (F.col("c_nationkey") % 12).cast("string")),
        F.concat(F.lit("mood_"), (F.col("c_custkey") % 11).cast("string"))))
    asked = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"), arc.alias("arc"), (F.col("c_acctbal") / 3000).alias("temperature"),
        (F.col("c_nationkey") * 3).alias("playlist_len"))
    return P.validate_requests(asked, fx.labels(spark, sf)).select("request_id", F.array_join("errors", "; ").alias("errors"))


@query("split_track_ids", """
 SELECT request_id, pos, id, valid, CASE WHEN valid THEN 'spotify:track:' || id END AS uri,
  CASE WHEN valid THEN (row_number() OVER (PARTITION BY request_id, valid ORDER BY pos) - 1) // 100 END AS batch_no FROM (
   SELECT user_id AS request_id, event_id AS pos, id, regexp_matches(id, '^[A-Za-z0-9]+$') AS valid FROM (
    SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN props ELSE event_type || event_id END AS id FROM events))""")
def split_track_ids(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("pos"), F.when(
            F.col("event_type") == "error", F.col("props")).otherwise(
            F.concat("event_type", F.col("event_id").cast("string"))).alias("id"))
    return C.split_track_ids(rows)


@query("capture_errors", """
 SELECT d.doc_id AS id, CASE WHEN l.toxic = 1 THEN substr(d.lang || 'Error: ' || substr(d.text, 1, 200), 1, 500) END AS extraction_error
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def capture_errors(spark, sf):
    marks = fx.table(spark, sf, "labels").select("doc_id", "toxic")
    results = fx.table(spark, sf, "documents").join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, F.concat("lang", F.lit("Error"))).alias("error_type"),
        F.col("text").alias("error_message"))
    return C.capture_errors(results, 200, 500)


def _count_words(row: dict) -> dict:
    words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
    if len(words) < 50:
        raise ValueError(f"{len(words)} words")
    return {"n_words": len(words)}


@query("enrich_pending", """
 SELECT id, CASE WHEN waiting AND n >= 50 THEN n END AS n_words,
  CASE WHEN processed_at IS NOT NULL THEN '2024-01-01' WHEN waiting AND n >= 50 THEN '2024-06-01' END AS stamped,
  CASE WHEN waiting AND n < 50 THEN 'ValueError: ' || n || ' words' ELSE extraction_error END AS extraction_error
 FROM (SELECT e.*, e.processed_at IS NULL AND e.extraction_error IS NULL AS waiting,
   len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM extraction e JOIN documents d ON d.doc_id = e.id)""", ("extraction",))
def enrich_pending(spark, sf):
    texts = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    songs = fx.extraction(spark, sf).join(texts, "id")
    result = T.StructType([T.StructField("n_words", T.LongType())])
    done = E.enrich_pending(songs, "id", new_path(spark, "enrichment"), "id", _count_words, result, F.to_timestamp(F.lit("2024-06-01 00:00:00")),
                            files=16, files_per_commit=8)
    return done.select("id", "n_words", F.date_format("processed_at", "yyyy-MM-dd").alias("stamped"), "extraction_error")


@query("transition_band", """
 SELECT d.doc_id, CASE WHEN pct >= 70 THEN 'high' WHEN pct >= 50 THEN 'mid' WHEN pct IS NOT NULL THEN 'low' END AS band
 FROM documents d LEFT JOIN (SELECT doc_id, round(score * 100) AS pct FROM preds) p ON p.doc_id = d.doc_id""", ("preds",))
def transition_bands(spark, sf):
    scored = fx.table(spark, sf, "documents").join(fx.predictions(spark, sf), "doc_id", "left")
    return scored.select("doc_id", transition_band(F.col("score")).alias("band"))


# --- joins -----------------------------------------------------------------------------------------

@query("feature_scan_join", """
 SELECT p.p_partkey AS song_id, p.p_size AS tempo, p.p_retailprice AS energy, d.lang AS language, d.source AS album
 FROM part p JOIN documents d ON d.doc_id = p.p_partkey""")
def feature_scan_join(spark, sf):
    features = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("song_id"), F.col("p_size").alias("tempo"), F.col("p_retailprice").alias("energy"))
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("source").alias("album"))
    return X.feature_scan_join(features, docs)


@query("full_metadata_join", """
 SELECT p.p_partkey AS song_id, p.p_name AS name, coalesce(d.source, '') AS album, coalesce(d.lang, 'en') AS language,
  CASE WHEN e.vec_id IS NULL THEN '{}' ELSE '{"mood_' || e.label || '":1.0}' END AS mood_scores,
  CASE WHEN e.vec_id IS NULL THEN '' ELSE 'mood_' || e.label END AS cluster_label, e.label AS cluster_id
 FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey LEFT JOIN embeddings e ON e.vec_id = p.p_partkey""")
def full_metadata_join(spark, sf):
    part, docs = fx.table(spark, sf, "part"), fx.table(spark, sf, "documents")
    features = part.select(F.col("p_partkey").alias("song_id"))
    songs = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).join(docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("album"), F.col("lang").alias("language")), "id", "left")
    name = F.concat(F.lit("mood_"), F.col("label").cast("string"))
    moods = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("song_id"), F.col("label").alias("cluster_id"),
        F.to_json(F.create_map(name, F.lit(1.0))).alias("mood_scores"))
    return X.full_metadata_join(features, songs, moods, fx.labels(spark, sf)).select(
        "song_id", "name", "album", "language", "mood_scores", "cluster_label", "cluster_id")


@query("patch_genre_language", """
 , last AS (SELECT l_partkey AS id, arg_max(genre, k) AS genre FROM (
   SELECT l_partkey, CASE l_returnflag WHEN 'R' THEN 'salsa' WHEN 'A' THEN 'anime' ELSE 'jazz' END AS genre,
    l_orderkey * 10 + l_linenumber + l_extendedprice / 1e7 AS k FROM lineitem) GROUP BY 1)
 SELECT s.id, coalesce(l.genre, 'unknown') AS genre, CASE l.genre WHEN 'salsa' THEN 'es' WHEN 'anime' THEN 'ja' ELSE 'en' END AS language
 FROM songs s LEFT JOIN last l ON l.id = s.id""", ("songs",))
def patch_genre_language(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(
        "l_partkey", F.when(F.col("l_returnflag") == "R", "salsa").when(F.col("l_returnflag") == "A", "anime").otherwise(
            "jazz").alias("genre"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_extendedprice") / 1e7).alias("ord"))
    return C.patch_genre_language(fx.songs(spark, sf).select("id", "language"), lines, "l_partkey", "genre", "ord").select(
        "id", "genre", "language")


@query("features_default_zero", """
 SELECT d.doc_id AS id, coalesce(p.p_size, 0)::DOUBLE AS tempo, coalesce(p.p_retailprice, 0)::DOUBLE AS energy
 FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id * 3""")
def features_default_zero(spark, sf):
    songs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 3).alias("k"))
    features = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), F.col("p_size").alias("tempo"), F.col("p_retailprice").alias("energy"))
    keyed = songs.join(features, "k").select(F.col("id").alias("song_id"), "tempo", "energy")
    return X.features_default_zero(songs.select("id"), keyed, ["tempo", "energy"])


@query("pack_metadata", """
 SELECT id, name, artist, language, '{"tempo":' || tempo || ',"energy":' || round(energy, 6) || '}' AS features_json FROM songs""", ("songs",))
def pack_metadata(spark, sf):
    rows = fx.songs(spark, sf).withColumn("energy", F.round("energy", 6))
    return X.pack_metadata(rows, ["name", "artist", "language"], ["tempo", "energy"])


# --- aggregates ------------------------------------------------------------------------------------

@query("extraction_status", """
 SELECT count(*) AS total, count(processed_at) AS done, count(extraction_error) AS failed,
  count(*) FILTER (processed_at IS NULL AND extraction_error IS NULL) AS pending FROM extraction""", ("extraction",))
def extraction_status(spark, sf):
    return C.extraction_status(fx.extraction(spark, sf))


@query("language_distribution", "SELECT language, count(*) AS n FROM extraction GROUP BY language", ("extraction",))
def language_distribution(spark, sf):
    return C.language_distribution(fx.extraction(spark, sf))


@query("collection_counts", """
 SELECT (SELECT count(*) FROM songs) AS songs, count(*) AS moods, string_agg(label, ',' ORDER BY label) AS labels FROM names""", ("songs", "names"))
def collection_counts(spark, sf):
    return C.collection_counts(fx.vectors(spark, sf), fx.labels(spark, sf))


# --- dedup and sampling ------------------------------------------------------------------------------

@query("dedup_first", "SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY text")
def dedup_first(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return C.dedup_first(docs, "text", "doc_id").select("doc_id", F.md5("text").alias("key"))


DRAWN = f"""
 WITH genres AS (SELECT doc_id, source || '-' || lang AS genre FROM documents),
 q AS (SELECT greatest(1, {SAMPLE_SIZE} // count(DISTINCT genre)) AS share, count(*) AS n FROM genres),
 drawn AS (SELECT doc_id, genre FROM genres, q WHERE true QUALIFY q.n <= {SAMPLE_SIZE} OR
  row_number() OVER (PARTITION BY genre ORDER BY md5('strata|' || doc_id), doc_id) <= q.share)"""


def _genres(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("genre"))


@query("stratified_sample", DRAWN + " SELECT doc_id, genre FROM drawn")
def stratified_sample(spark, sf):
    return C.stratified_sample(_genres(spark, sf), "genre", SAMPLE_SIZE, "strata", ["doc_id"])


@query("sample_topup", DRAWN + f"""
 , kept AS (SELECT doc_id, genre FROM drawn QUALIFY row_number() OVER (ORDER BY md5('top|' || doc_id), doc_id) <= {SAMPLE_SIZE}),
 fill AS (SELECT doc_id, genre FROM genres WHERE doc_id NOT IN (SELECT doc_id FROM drawn)
  QUALIFY row_number() OVER (ORDER BY md5('top|' || doc_id), doc_id) <= {SAMPLE_SIZE} - (SELECT count(*) FROM drawn))
 SELECT * FROM kept UNION ALL SELECT * FROM fill""")
def sample_topup(spark, sf):
    drawn = C.stratified_sample(_genres(spark, sf), "genre", SAMPLE_SIZE, "strata", ["doc_id"])
    return C.sample_topup(_genres(spark, sf), drawn, SAMPLE_SIZE, "top", ["doc_id"])


@query("uniform_sample", f"""
 SELECT doc_id, genre FROM (SELECT doc_id, source || '-' || lang AS genre FROM documents)
 QUALIFY row_number() OVER (ORDER BY md5('uni|' || doc_id), doc_id) <= {SAMPLE_SIZE}""")
def uniform_sample(spark, sf):
    return C.uniform_sample(_genres(spark, sf), SAMPLE_SIZE, "uni", ["doc_id"])


@query("train_val_test_split", """
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, count(*) OVER () AS n, row_number() OVER (ORDER BY
   md5('split|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r
  FROM lineitem)""")
def train_val_test_split(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return C.train_val_test_split(rows, "split", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


# --- mood maps ---------------------------------------------------------------------------------------

@query("parse_mood_scores", """
 SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END::INTEGER AS n_keys,
  CASE WHEN event_type = 'error' THEN NULL ELSE (props ->> '$.k')::DOUBLE END AS k FROM events""")
def parse_mood_scores(spark, sf):
    text = F.when(F.col("event_type") != "error", F.col("props"))
    parsed = fx.table(spark, sf, "events").select("event_id", M.parse_mood_scores(text).alias("m"))
    return parsed.select("event_id", F.size("m").alias("n_keys"), F.try_element_at("m", F.lit("k")).alias("k"))


@query("mood_vector", """
 SELECT event_id, 0.0::DOUBLE AS a, (props ->> '$.k')::DOUBLE AS k, 0.0::DOUBLE AS z FROM events""")
def mood_vector(spark, sf):
    wanted = F.array(F.lit("a"), F.lit("k"), F.lit("z"))
    v = M.mood_vector(M.parse_mood_scores(F.col("props")), wanted)
    return fx.table(spark, sf, "events").select("event_id", v.alias("v")).select(
        "event_id", F.element_at("v", 1).alias("a"), F.element_at("v", 2).alias("k"), F.element_at("v", 3).alias("z"))


@query("top_moods", "SELECT id, (rank + 1)::INTEGER AS rank, label_id, score FROM ranked WHERE rank < 3", ("ranked",))
def top_moods(spark, sf):
    return S.top_moods(fx.bare_profiles(spark, sf), 3)


@query("mood_index", "SELECT id, mood::INTEGER AS mood, rank::INTEGER AS rank, score FROM idx", ("idx",))
def mood_index(spark, sf):
    return O.mood_index(fx.bare_profiles(spark, sf).select("id", "scores", "mood_ids"))


@query("mood_index_sizes", """
 SELECT n.label_id, count(i.id) AS entries, count(i.id) < 100 AS thin FROM names n LEFT JOIN idx i ON i.mood = n.label_id GROUP BY n.label_id""", ("idx", "names"))
def mood_index_sizes(spark, sf):
    return O.mood_index_sizes(O.mood_index(fx.bare_profiles(spark, sf)), fx.labels(spark, sf))


@query("mood_pools", "SELECT mood::INTEGER AS mood, id, pos, n AS pool_n FROM pools", ("pools",))
def mood_pools(spark, sf):
    rows, _ = fx.pools(spark, sf)
    return rows.filter("other = -1").select("mood", "id", "pos", F.col("pos_n").alias("pool_n"))


@query("bridge_pool", "SELECT a.mood::INTEGER AS mood, b.mood::INTEGER AS other, a.id FROM idx a JOIN idx b ON a.id = b.id AND a.mood <> b.mood", ("idx",))
def bridge_pool(spark, sf):
    return O.bridge_pool(O.mood_index(fx.bare_profiles(spark, sf)))


@query("mood_scores", "SELECT id AS song_id, label_id, score FROM moods", ("moods",))
def mood_scores(spark, sf):
    return K.mood_scores(fx.vectors(spark, sf), fx.centroids(spark, sf), fx.SHARPNESS)
