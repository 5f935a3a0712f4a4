"""Queries on vectors, clusters, neighbours, graphs, pairs, the classifier and playlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.functions.vectors import cosine_distance, cosine_score, l2_distance, tidy
from arcloom.operators import acoustic as A
from arcloom.operators import catalogue as C
from arcloom.operators import centroids as K
from arcloom.operators import clustering as L
from arcloom.operators import features as X
from arcloom.operators import graphs as G
from arcloom.operators import neighbours as N
from arcloom.operators import vector_index as V
from arcloom.operators import pairs as R
from arcloom.operators import playlist as P
from arcloom.operators import requests as Q
from arcloom.operators import scoring as S
from arcloom.operators import transition as T
from arcloom.plans import fixtures as fx
from arcloom.operators.moods import mood_pools, pool_sizes
from arcloom.plans.registry import query, u01
from arcloom.sources.artefacts import load_transition_model, save_model
from arcloom.sources.workspace import store, store_by_key

PAIRS = 600
TRAIN_PAIRS = 3000


# --- vectors and clusters --------------------------------------------------------------------------

def _neighbouring_ids(spark, sf):
    v = fx.vectors(spark, sf)
    other = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return v.join(other, "id")


@query("l2_distance", "SELECT a.id, round(list_distance(a.emb, b.emb), 6) AS dist FROM songs a JOIN songs b ON b.id = a.id + 1", ("songs",))
def l2(spark, sf):
    return _neighbouring_ids(spark, sf).select("id", F.round(l2_distance(F.col("embedding"), F.col("other")), 6).alias("dist"))


@query("cosine_score", """
 SELECT a.id, round(list_dot_product(a.emb, b.emb) / ((sqrt(list_dot_product(a.emb, a.emb)) + 1e-8) * (sqrt(list_dot_product(b.emb, b.emb)) + 1e-8)), 6) + 0.0 AS each_form,
  round(list_dot_product(a.emb, b.emb) / (sqrt(list_dot_product(a.emb, a.emb)) * sqrt(list_dot_product(b.emb, b.emb)) + 1e-8), 6) + 0.0 AS product_form
 FROM songs a JOIN songs b ON b.id = a.id + 1""", ("songs",))
def cosine(spark, sf):
    a, b = F.col("embedding"), F.col("other")
    return _neighbouring_ids(spark, sf).select(
        "id", tidy(cosine_score(a, b), 6).alias("each_form"), tidy(cosine_score(a, b, "product"), 6).alias("product_form"))


@query("mood_cosine_distance", """
 , w AS (SELECT id, list(score ORDER BY label_id) AS v FROM moods GROUP BY id)
 SELECT a.id, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-8), 6) + 0.0 AS dist
 FROM w a JOIN w b ON b.id = a.id + 1""", ("moods",))
def mood_cosine_distance(spark, sf):
    v = fx.bare_profiles(spark, sf).select("id", "scores")
    other = v.select((F.col("id") - 1).alias("id"), F.col("scores").alias("other"))
    return v.join(other, "id").select("id", tidy(cosine_distance(F.col("scores"), F.col("other")), 6).alias("dist"))


@query("embedding_stats", """
 SELECT round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max,
  (SELECT round(avg(s), 6) FROM (SELECT stddev_pop(x) AS s FROM cells GROUP BY pos)) AS mean_dim_std FROM cells""", ("cells",))
def embedding_stats(spark, sf):
    stats = X.embedding_stats(fx.vectors(spark, sf))
    return stats.select(*[tidy(F.col(c), 6).alias(c) for c in stats.columns])


@query("scaler_fit", """
 SELECT (pos - 1)::INTEGER AS pos, round(avg(x), 6) + 0.0 AS mean, round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END, 6) AS std FROM cells GROUP BY pos""", ("cells",))
def scaler_fit(spark, sf):
    return X.scaler_fit(fx.vectors(spark, sf)).select("pos", tidy(F.col("mean"), 6).alias("mean"), tidy(F.col("std"), 6).alias("std"))


@query("scaler_transform", """
 SELECT id, (pos - 1)::INTEGER AS pos, round((x - avg(x) OVER (PARTITION BY pos)) / stddev_pop(x) OVER (PARTITION BY pos), 6) + 0.0 AS z FROM cells""", ("cells",))
def scaler_transform(spark, sf):
    v = fx.vectors(spark, sf)
    return X.scaler_transform(v, X.scaler_fit(v)).select("id", F.posexplode("scaled").alias("pos", "z")).withColumn("z", tidy(F.col("z"), 6))


@query("reduce_dims")
def reduce_dims(spark, sf):
    reduced, _ = X.reduce_dims(fx.vectors(spark, sf), 8)
    return reduced.select("id", F.posexplode("reduced").alias("pos", "x")).withColumn("x", tidy(F.col("x"), 5))


@query("song_centroid_distance", "SELECT id, label_id, round(dist, 6) AS dist FROM dists", ("dists",))
def song_centroid_distance(spark, sf):
    return K.song_centroid_distance(fx.vectors(spark, sf), fx.centroids(spark, sf)).withColumn("dist", F.round("dist", 6))


@query("kmeans_assign", """
 SELECT id, label_id, round(dist, 6) AS dist FROM dists QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, label_id) = 1""", ("dists",))
def kmeans_assign(spark, sf):
    return K.kmeans_assign(fx.vectors(spark, sf).select("id", "embedding"), fx.centroids(spark, sf)).select(
        "id", "label_id", F.round("dist", 6).alias("dist"))


ASSIGNED = " , assigned AS (SELECT id, label_id, dist FROM dists QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, label_id) = 1)"


@query("kmeans_update", ASSIGNED + """
 SELECT a.label_id, (c.pos - 1)::INTEGER AS pos, round(avg(c.x), 6) + 0.0 AS x FROM assigned a JOIN cells c ON c.id = a.id GROUP BY a.label_id, c.pos""", ("dists", "cells"))
def kmeans_update(spark, sf):
    assigned = K.kmeans_assign(fx.vectors(spark, sf).select("id", "embedding"), fx.centroids(spark, sf))
    return K.kmeans_update(assigned).select("label_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", tidy(F.col("x"), 6))


@query("kmeans_inertia", "SELECT round(sum(d.dist * d.dist), 4) AS inertia FROM dists d JOIN songs s ON s.id = d.id AND s.label = d.label_id", ("dists",))
def kmeans_inertia(spark, sf):
    return K.kmeans_inertia(fx.vectors(spark, sf), fx.centroids(spark, sf), "label").select(F.round("inertia", 4).alias("inertia"))


@query("cluster_sizes", ASSIGNED + " SELECT n.label_id, count(a.id) AS size FROM names n LEFT JOIN assigned a ON a.label_id = n.label_id GROUP BY n.label_id", ("dists", "names"))
def cluster_sizes(spark, sf):
    assigned = K.kmeans_assign(fx.vectors(spark, sf).select("id", "embedding"), fx.centroids(spark, sf))
    return K.cluster_sizes(assigned, fx.labels(spark, sf))


@query("cluster_exemplars", """
 SELECT s.label AS cluster_id, s.id, round(d.dist, 6) AS distance, s.name, s.artist, round(s.tempo, 1) AS tempo, round(s.energy, 3) AS energy,
  round(s.valence, 3) + 0.0 AS valence, round(s.danceability, 3) + 0.0 AS danceability,
  row_number() OVER (PARTITION BY s.label ORDER BY round(d.dist, 6), s.id)::INTEGER AS rank
 FROM songs s JOIN dists d ON d.id = s.id AND d.label_id = s.label
 QUALIFY row_number() OVER (PARTITION BY s.label ORDER BY round(d.dist, 6), s.id) <= 5""", ("dists",))
def cluster_exemplars(spark, sf):
    return K.cluster_exemplars(fx.songs(spark, sf), fx.centroids(spark, sf), label="label")


@query("label_clusters", """
 SELECT DISTINCT label AS label_id, CASE WHEN label % 2 = 0 THEN 'even ' || label ELSE 'cluster_' || label END AS label,
  CASE WHEN label % 2 = 0 THEN 'named' ELSE '' END AS description FROM embeddings""")
def label_clusters(spark, sf):
    clusters = fx.labels(spark, sf).select("label_id")
    given = clusters.filter("label_id % 2 = 0").select(
        "label_id", F.concat(F.lit("even "), F.col("label_id").cast("string")).alias("label"), F.lit("named").alias("description"))
    return K.label_clusters(clusters, given)


@query("silhouette", """
 , pairs AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.emb, b.emb)) AS total, count(*) AS n
  FROM songs a JOIN songs b ON true GROUP BY a.id, a.label, b.label),
 ab AS (SELECT id, max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a, max(CASE WHEN own = other THEN n END) AS own_n,
  min(CASE WHEN own <> other THEN total / n END) AS b FROM pairs GROUP BY id)
 SELECT count(*) AS n, round(avg(CASE WHEN own_n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) + 0.0 AS silhouette FROM ab""", ("songs",))
def silhouette(spark, sf):
    return L.silhouette(fx.vectors(spark, sf), "label").select("n", tidy(F.col("silhouette"), 6).alias("silhouette"))


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    songs = fx.vectors(spark, sf)
    centroids, cost = L.kmeans_fit(songs, 8)
    return K.cluster_sizes(K.kmeans_assign(songs.select("id", "embedding"), centroids), centroids).withColumn(
        "cost", F.lit(round(float(cost), 4)))


@query("kmeans_invariants", """
 SELECT label_id::INTEGER AS label_id, (SELECT count(*) FROM songs) AS rows, true AS costs_agree, true AS centre_is_mean, true AS not_empty
 FROM (SELECT unnest(range(0, 8)) AS label_id)""", ("songs",))
def kmeans_invariants(spark, sf):
    """What holds for any converged fit: sizes add up, the cost is the inertia of its centroids, and these are the means of their songs."""
    songs = fx.vectors(spark, sf)
    centroids, cost = L.kmeans_fit(songs, 8)
    assigned = store(K.kmeans_assign(songs.select("id", "embedding"), centroids), "assigned")
    inertia = K.kmeans_inertia(assigned, centroids).scalar()
    means = K.kmeans_update(assigned).withColumnRenamed("centroid", "mean")
    sizes = K.cluster_sizes(assigned, centroids)
    total = sizes.agg(F.sum("size")).scalar()
    return centroids.join(means, "label_id").join(sizes, "label_id").select(
        "label_id", total.alias("rows"), (F.abs(inertia - cost) < 1e-6 * cost).alias("costs_agree"),
        (l2_distance(F.col("mean"), F.col("centroid")) < 1e-3).alias("centre_is_mean"), (F.col("size") > 0).alias("not_empty"))


@query("pick_best_k")
def pick_best_k(spark, sf):
    best, history = L.pick_best_k(fx.vectors(spark, sf))
    return history.withColumn("best", F.col("k") == best)


# --- neighbours and graphs ---------------------------------------------------------------------------

@query("knn_l2", "SELECT src, dst, rank::INTEGER AS rank, dist FROM nn WHERE rank <= 50", ("nn",))
def knn_l2(spark, sf):
    return N.knn_l2(fx.vectors(spark, sf), 50).select("src", "dst", "rank", "dist")


PROBED = f""" , total AS (SELECT ceil(sqrt(ceil(count(*) / 50.0))) AS coarse FROM songs),
 p1 AS (SELECT row_number() OVER (ORDER BY md5('pivot|' || id), id) - 1 AS c, id, emb FROM songs QUALIFY c < (SELECT coarse FROM total)),
 far AS MATERIALIZED (SELECT s.id, p.c, row_number() OVER (PARTITION BY s.id ORDER BY list_distance(s.emb, p.emb), p.c) AS r FROM songs s, p1 p),
 p2 AS MATERIALIZED (SELECT s.id AS cell, s.emb, f.c FROM songs s JOIN far f ON f.id = s.id AND f.r = 1
   WHERE s.id IN (SELECT id FROM p1) OR {u01("'cell|' || s.id")} < 0.02),
 home AS MATERIALIZED (SELECT s.id, f.c, arg_min(p.cell, (list_distance(s.emb, p.emb), p.cell)) AS cell
   FROM songs s JOIN far f ON f.id = s.id AND f.r = 1 JOIN p2 p ON p.c = f.c GROUP BY s.id, f.c),
 block AS (SELECT id FROM songs ORDER BY md5('block|' || id), id LIMIT 256),
 pairs AS MATERIALIZED (SELECT n.src, n.dst, f.r AS coarse_place FROM nn n JOIN home h ON h.id = n.dst JOIN far f ON f.id = n.src AND f.c = h.c
   WHERE n.rank <= 10 AND n.src IN (SELECT id FROM block)),
 first_probe AS MATERIALIZED (SELECT min(coarse_place) AS coarse FROM (
   SELECT coarse_place, sum(count(*)) OVER (ORDER BY coarse_place) AS n FROM pairs GROUP BY coarse_place) WHERE n >= 0.96::DOUBLE * (SELECT count(*) FROM pairs) - 1e-9),
 spot AS MATERIALIZED (SELECT s.id, p.cell, row_number() OVER (PARTITION BY s.id ORDER BY round(list_distance(s.emb, p.emb), 6), p.cell) AS r
   FROM songs s JOIN far f ON f.id = s.id AND f.r <= (SELECT coarse FROM first_probe) JOIN p2 p ON p.c = f.c),
 places AS MATERIALIZED (SELECT q.src, q.dst, o.r FROM pairs q JOIN home h ON h.id = q.dst LEFT JOIN spot o ON o.id = q.src AND o.cell = h.cell),
 probe AS MATERIALIZED (SELECT (SELECT coarse FROM first_probe) AS coarse, min(r) AS cells FROM (
   SELECT r, sum(count(*)) OVER (ORDER BY r) AS n FROM places WHERE r IS NOT NULL GROUP BY r) WHERE n >= 0.92::DOUBLE * (SELECT count(*) FROM pairs) - 1e-9),
 pr AS (SELECT src, dst, dist, rank FROM (
   SELECT q.id AS src, d.id AS dst, round(list_distance(a.emb, b.emb), 6) AS dist,
    row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(a.emb, b.emb), 6), d.id) AS rank
   FROM spot q JOIN home d ON d.cell = q.cell AND d.id <> q.id JOIN songs a ON a.id = q.id JOIN songs b ON b.id = d.id
   WHERE q.r <= (SELECT cells FROM probe)) WHERE rank <= 10)"""


@query("knn_calibration", PROBED + """
 SELECT coarse::INTEGER AS coarse, cells::INTEGER AS cells, round((SELECT count(*) FROM places WHERE r <= cells) / (SELECT count(*) FROM places), 6) AS block_recall FROM probe""",
       ("nn",))
def knn_calibration(spark, sf):
    probes = V.calibrate(spark, V.build_index(fx.vectors(spark, sf), 10, cell_rows=50))
    return spark.createDataFrame([(probes.coarse, probes.cells, round(probes.recall, 6))], "coarse int, cells int, block_recall double")


@query("knn_approx", PROBED + " SELECT src, dst, rank::INTEGER AS rank, dist FROM pr", ("nn",))
def knn_approx(spark, sf):
    return V.knn_approx(fx.vectors(spark, sf), 10, cell_rows=50).select("src", "dst", "rank", "dist")


@query("knn_recall", PROBED + """
 SELECT round(count(pr.dst) / count(*), 6) AS recall FROM nn LEFT JOIN pr ON pr.src = nn.src AND pr.dst = nn.dst WHERE nn.rank <= 10""", ("nn",))
def knn_recall(spark, sf):
    exact = N.knn_l2(fx.vectors(spark, sf), 10).select("src", "dst")
    found = knn_approx(spark, sf).select("src", "dst", F.lit(1).alias("hit"))
    return exact.join(found, ["src", "dst"], "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@query("centroid_similarity", "SELECT i, j, round(sim, 6) + 0.0 AS sim FROM sims", ("sims",))
def centroid_similarity(spark, sf):
    return K.centroid_similarity(fx.centroids(spark, sf)).withColumn("sim", tidy(F.col("sim"), 6))


MOOD_EDGES = """SELECT s.i AS source, s.j AS target, round(s.sim, 4) AS weight, a.label AS source_label, b.label AS target_label
 FROM sims s JOIN names a ON a.label_id = s.i JOIN names b ON b.label_id = s.j WHERE s.sim >= {t}"""


@query("mood_graph", MOOD_EDGES.format(t="0.2"), ("sims", "names"))
def mood_graph(spark, sf):
    return G.mood_graph(K.centroid_similarity(fx.centroids(spark, sf)), fx.labels(spark, sf), 0.2)


@query("graph_connectivity", """
 , links AS (SELECT i AS u, j AS v FROM sims WHERE sim >= 0.22 UNION SELECT j, i FROM sims WHERE sim >= 0.22),
 h1 AS (SELECT min(label_id) AS id FROM names), h2 AS (SELECT id FROM h1 UNION SELECT v FROM links WHERE u IN (SELECT id FROM h1)),
 h3 AS (SELECT id FROM h2 UNION SELECT v FROM links WHERE u IN (SELECT id FROM h2)),
 h4 AS (SELECT id FROM h3 UNION SELECT v FROM links WHERE u IN (SELECT id FROM h3)),
 h5 AS (SELECT id FROM h4 UNION SELECT v FROM links WHERE u IN (SELECT id FROM h4)),
 h6 AS (SELECT id FROM h5 UNION SELECT v FROM links WHERE u IN (SELECT id FROM h5)),
 h7 AS (SELECT id FROM h6 UNION SELECT v FROM links WHERE u IN (SELECT id FROM h6)),
 h8 AS (SELECT id FROM h7 UNION SELECT v FROM links WHERE u IN (SELECT id FROM h7)),
 h9 AS (SELECT id FROM h8 UNION SELECT v FROM links WHERE u IN (SELECT id FROM h8))
 SELECT n.label_id AS id, n.label_id IN (SELECT id FROM h9) AS reachable FROM names n""", ("sims", "names"))
def graph_connectivity(spark, sf):
    similarity = K.centroid_similarity(fx.centroids(spark, sf))
    nodes = fx.labels(spark, sf).select(F.col("label_id").alias("id"), "label")
    edges = G.mood_graph(similarity, fx.labels(spark, sf), 0.22)
    return G.graph_connectivity(nodes, edges).select("id", "reachable")


@query("connectivity_report", """
 , links AS (SELECT i AS u, j AS v FROM sims WHERE sim >= 0.25 UNION SELECT j, i FROM sims WHERE sim >= 0.25),
 far AS (WITH RECURSIVE r AS (SELECT min(label_id) AS id FROM names UNION SELECT v FROM r JOIN links ON u = r.id) SELECT id FROM r)
 SELECT count(*) AS nodes, count(*) FILTER (label_id IN (SELECT id FROM far)) AS reached,
  coalesce(string_agg(label, ', ' ORDER BY label) FILTER (label_id NOT IN (SELECT id FROM far)), '') AS isolated,
  count(*) = count(*) FILTER (label_id IN (SELECT id FROM far)) AND (SELECT count(*) FROM links) > 0 AS connected FROM names""", ("sims", "names"))
def connectivity_report(spark, sf):
    nodes = fx.labels(spark, sf).select(F.col("label_id").alias("id"), "label")
    edges = G.mood_graph(K.centroid_similarity(fx.centroids(spark, sf)), fx.labels(spark, sf), 0.25)
    return G.connectivity_report(G.graph_connectivity(nodes, edges), edges)


@query("auto_threshold", """
 , steps AS (SELECT unnest([0.7, 0.6, 0.5, 0.4, 0.3, 0.2]::DOUBLE[]) AS t),
 h1 AS (SELECT t, min(label_id) AS id FROM steps, names GROUP BY t),
 links AS (SELECT i AS u, j AS v, sim FROM sims UNION ALL SELECT j, i, sim FROM sims),
 h2 AS (SELECT t, id FROM h1 UNION SELECT h.t, l.v FROM h1 h JOIN links l ON l.u = h.id AND l.sim >= h.t),
 h3 AS (SELECT t, id FROM h2 UNION SELECT h.t, l.v FROM h2 h JOIN links l ON l.u = h.id AND l.sim >= h.t),
 h4 AS (SELECT t, id FROM h3 UNION SELECT h.t, l.v FROM h3 h JOIN links l ON l.u = h.id AND l.sim >= h.t),
 h5 AS (SELECT t, id FROM h4 UNION SELECT h.t, l.v FROM h4 h JOIN links l ON l.u = h.id AND l.sim >= h.t),
 h6 AS (SELECT t, id FROM h5 UNION SELECT h.t, l.v FROM h5 h JOIN links l ON l.u = h.id AND l.sim >= h.t),
 h7 AS (SELECT t, id FROM h6 UNION SELECT h.t, l.v FROM h6 h JOIN links l ON l.u = h.id AND l.sim >= h.t),
 h8 AS (SELECT t, id FROM h7 UNION SELECT h.t, l.v FROM h7 h JOIN links l ON l.u = h.id AND l.sim >= h.t),
 h9 AS (SELECT t, id FROM h8 UNION SELECT h.t, l.v FROM h8 h JOIN links l ON l.u = h.id AND l.sim >= h.t),
 full_at AS (SELECT max(t) AS t FROM (SELECT t FROM h9 GROUP BY t HAVING count(*) = (SELECT count(*) FROM names))),
 chosen AS (SELECT coalesce(t, 0.2) AS t, t IS NOT NULL AS connected FROM full_at)
 SELECT s.i AS source, s.j AS target, round(s.sim, 4) AS weight, a.label AS source_label, b.label AS target_label, c.t AS threshold, c.connected
 FROM sims s JOIN chosen c ON s.sim >= c.t JOIN names a ON a.label_id = s.i JOIN names b ON b.label_id = s.j""", ("sims", "names"))
def auto_threshold(spark, sf):
    return G.auto_threshold(K.centroid_similarity(fx.centroids(spark, sf)), fx.labels(spark, sf))


@query("mood_graph_adjacency", """
 , e AS (SELECT i AS label_id, j AS other, round(sim, 4) AS w FROM sims WHERE sim >= 0.2 UNION ALL SELECT j, i, round(sim, 4) FROM sims WHERE sim >= 0.2),
 t AS (SELECT e.label_id, string_agg(printf('%s (%.2f)', o.label, w), ', ' ORDER BY printf('%s (%.2f)', o.label, w)) AS text
  FROM e JOIN names o ON o.label_id = e.other GROUP BY e.label_id)
 SELECT n.label_id, n.label, coalesce(t.text, 'none') AS connections FROM names n LEFT JOIN t ON t.label_id = n.label_id""", ("sims", "names"))
def mood_graph_adjacency(spark, sf):
    edges = G.mood_graph(K.centroid_similarity(fx.centroids(spark, sf)), fx.labels(spark, sf), 0.2)
    return G.mood_graph_adjacency(fx.labels(spark, sf), edges)


@query("song_graph", "SELECT src, dst, rank::INTEGER AS rank, dist, round(cosine, 4) + 0.0 AS score FROM nn WHERE rank <= 50 AND cosine >= 0.3", ("nn",))
def song_graph(spark, sf):
    return G.song_graph(G.scored_neighbours(fx.vectors(spark, sf)))


@query("song_graph_stats", """
 SELECT count(*) AS nodes, sum(kept)::BIGINT AS edges, sum(cut)::BIGINT AS pruned, round(avg(kept), 6) AS avg_degree,
  count(*) FILTER (kept = 0) AS isolated FROM (SELECT s.id, count(n.src) FILTER (n.cosine >= 0.3) AS kept, count(n.src) FILTER (n.cosine < 0.3) AS cut
  FROM songs s LEFT JOIN nn n ON n.src = s.id AND n.rank <= 50 GROUP BY s.id)""", ("nn",))
def song_graph_stats(spark, sf):
    songs = fx.vectors(spark, sf)
    return G.song_graph_stats(songs, G.scored_neighbours(songs)).withColumn("avg_degree", F.round("avg_degree", 6))


def _starts(spark, sf):
    """One request per song, heading for the next label's mood."""
    goal = F.transform("mood_ids", lambda m: F.when(m == (F.col("label") + 1) % 10, 1.0).otherwise(0.0))
    return fx.bare_profiles(spark, sf).select(F.col("id").alias("request_id"), F.col("id").alias("start"), goal.alias("target"))


PRICED = """
 , w AS (SELECT id, list(score ORDER BY label_id) AS v FROM moods GROUP BY id),
 starts AS (SELECT id AS request_id, id AS node, (label + 1) % 10 AS goal FROM songs),
 tolls AS (SELECT g.goal, w.id, list_distance(w.v, [CASE WHEN i = g.goal THEN 1.0 ELSE 0.0 END FOR i IN range(0, 10)]::DOUBLE[]) AS away
  FROM w CROSS JOIN (SELECT DISTINCT goal FROM starts) g),
 steps AS MATERIALIZED (SELECT t.goal, e.src, e.dst, 1 - least(e.score, 1.0) + 0.4 * t.away AS cost FROM edges e JOIN tolls t ON t.id = e.dst)"""


@query("mood_path_costs", PRICED + """ ,
 c0 AS (SELECT request_id, node, goal, 0.0::DOUBLE AS cost FROM starts),
 c1 AS (SELECT request_id, node, goal, min(cost) AS cost FROM (SELECT * FROM c0 UNION ALL SELECT c.request_id, s.dst, c.goal, c.cost + s.cost FROM c0 c JOIN steps s ON s.src = c.node AND s.goal = c.goal) GROUP BY ALL),
 c2 AS (SELECT request_id, node, goal, min(cost) AS cost FROM (SELECT * FROM c1 UNION ALL SELECT c.request_id, s.dst, c.goal, c.cost + s.cost FROM c1 c JOIN steps s ON s.src = c.node AND s.goal = c.goal) GROUP BY ALL),
 c3 AS (SELECT request_id, node, goal, min(cost) AS cost FROM (SELECT * FROM c2 UNION ALL SELECT c.request_id, s.dst, c.goal, c.cost + s.cost FROM c2 c JOIN steps s ON s.src = c.node AND s.goal = c.goal) GROUP BY ALL)
 SELECT request_id, node, round(cost, 6) AS cost FROM c3""", ("edges", "moods"))
def mood_path_costs(spark, sf):
    costs = G.mood_path_costs(_edges(spark, sf), fx.bare_profiles(spark, sf).select("id", "scores"), _starts(spark, sf), 3)
    return costs.withColumn("cost", F.round("cost", 6))


def _labels_sql(rounds: int) -> str:
    """Labels ``(cost, later, songs, before)`` after so many rounds of relaxation."""
    out = ", l0 AS (SELECT request_id, node, goal, ROW(0.0::DOUBLE, 0, 1, NULL::BIGINT) AS m FROM starts)"
    for i in range(rounds):
        out += f""", l{i + 1} AS MATERIALIZED (SELECT request_id, node, goal, min(m) AS m FROM (
  SELECT request_id, node, goal, ROW(m[1], 0, m[3], m[4]) AS m FROM l{i} UNION ALL
  SELECT l.request_id, s.dst, l.goal, ROW(l.m[1] + s.cost, 1, l.m[3] + 1, l.node) FROM l{i} l JOIN steps s ON s.src = l.node AND s.goal = l.goal) GROUP BY request_id, node, goal)"""
    return out


@query("mood_path_short", PRICED + _labels_sql(3) + """,
 ends AS (SELECT l.request_id, min(ROW(m[1], l.node)) FILTER (m[3] >= 4) AS e FROM l3 l GROUP BY 1)
 SELECT e.request_id, round(e.e[1], 6) AS cost, concat_ws('>', c.m[4], b.m[4], a.m[4], a.node) AS path FROM ends e JOIN l3 a ON a.request_id = e.request_id AND a.node = e.e[2]
 LEFT JOIN l3 b ON b.request_id = a.request_id AND b.node = a.m[4] LEFT JOIN l3 c ON c.request_id = b.request_id AND c.node = b.m[4]""", ("edges", "moods"))
def mood_path_short(spark, sf):
    """Paths of four songs, one request per song."""
    return _paths(spark, sf, 4)


def _paths(spark, sf, steps):
    paths = G.mood_path(_edges(spark, sf), fx.bare_profiles(spark, sf).select("id", "scores"), _starts(spark, sf), steps)
    return paths.select("request_id", F.round("cost", 6).alias("cost"), F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))


def _edges(spark, sf):
    return G.song_graph(G.scored_neighbours(fx.vectors(spark, sf)), fx.WALK_PRUNE)


@query("mood_path")
def mood_path(spark, sf):
    return _paths(spark, sf, G.MAX_STEPS)


# --- acoustic summaries ------------------------------------------------------------------------------

def _events(spark, sf):
    return fx.table(spark, sf, "events").withColumn("track", F.col("user_id"))


@query("frame_summary", """
 SELECT user_id AS track, round(avg(value), 6) AS rms_mean, round(avg(event_id % 7), 6) AS zcr_mean, round(stddev_pop(value), 6) AS rms_std,
  """ + ", ".join(f"round(avg(value) FILTER (event_id % 13 = {i}), 6) AS mfcc_{i + 1}" for i in range(13)) + " FROM events GROUP BY user_id")
def frame_summary(spark, sf):
    frames = _events(spark, sf).select("track", F.col("value").alias("rms"), (F.col("event_id") % 7).alias("zcr"),
                                       F.col("value").alias("coef"), (F.col("event_id") % 13).alias("bin"))
    out = A.frame_summary(frames, ["rms", "zcr"], "coef", "bin")
    return out.select("track", *[F.round(c, 6).alias(c) for c in out.columns if c != "track"])


@query("chroma_summary", "SELECT user_id AS track, round(avg(value), 6) AS chroma_mean, round(stddev_pop(value), 6) AS chroma_std FROM events GROUP BY user_id")
def chroma_summary(spark, sf):
    out = A.chroma_summary(_events(spark, sf).select("track", "value"))
    return out.select("track", F.round("chroma_mean", 6).alias("chroma_mean"), F.round("chroma_std", 6).alias("chroma_std"))


@query("fix_tempo_octave", """
 SELECT event_id, CASE WHEN value > 150 AND e <= 0.25 THEN value / 2 WHEN value < 90 AND e > 0.20 THEN value * 2 ELSE value END AS tempo,
  CASE WHEN value > 150 AND e <= 0.25 THEN value / 2 WHEN value < 60 THEN value * 2 ELSE value END AS legacy
 FROM (SELECT event_id, value, (event_id % 40) / 100.0::DOUBLE AS e FROM events)""")
def fix_tempo_octave(spark, sf):
    value, energy = F.col("value"), (F.col("event_id") % 40) / 100.0
    return _events(spark, sf).select("event_id", A.fix_tempo_octave(value, energy).alias("tempo"),
                                     A.fix_tempo_octave(value, energy, "legacy").alias("legacy"))


@query("valence_proxy", """
 WITH b AS (SELECT user_id AS track, event_id % 12 AS bin, avg(value / 500) AS m FROM events GROUP BY 1, 2)
 SELECT track, round(least(1, greatest(0, (coalesce(avg(m) FILTER (bin IN (0, 4, 7)), 0) - coalesce(avg(m) FILTER (bin IN (0, 3, 7)), 0) + 1) / 2)), 9) AS valence_proxy
 FROM b GROUP BY track""")
def valence_proxy(spark, sf):
    chroma = _events(spark, sf).select("track", (F.col("event_id") % 12).alias("bin"), (F.col("value") / 500).alias("value"))
    return A.valence_proxy(chroma).withColumn("valence_proxy", F.round("valence_proxy", 9))


@query("danceability_proxy", """
 SELECT track, round(CASE WHEN count(gap) = 0 THEN 0 ELSE least(1, greatest(0, 1 - stddev_pop(gap) / (avg(gap) + 1e-6))) END, 6) AS danceability_proxy FROM (
  SELECT user_id AS track, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) GROUP BY track""")
def danceability_proxy(spark, sf):
    beats = _events(spark, sf).select("track", F.col("ts").cast("timestamp").cast("double").alias("beat_time"))
    return A.danceability_proxy(beats).withColumn("danceability_proxy", F.round("danceability_proxy", 6))


@query("acousticness_proxy", """
 SELECT track, round(lo / (lo + hi + 1e-6), 6) AS acousticness_proxy FROM (SELECT user_id AS track,
  coalesce(avg(value) FILTER ((event_id % 40) * 25 < 500), 0) AS lo, coalesce(avg(value) FILTER ((event_id % 40) * 25 >= 500), 0) AS hi FROM events GROUP BY 1)""")
def acousticness_proxy(spark, sf):
    spectrum = _events(spark, sf).select("track", ((F.col("event_id") % 40) * 25).alias("freq"), F.col("value").alias("magnitude"))
    return A.acousticness_proxy(spectrum).withColumn("acousticness_proxy", F.round("acousticness_proxy", 6))


@query("feature_rows", """
 WITH g AS (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
 d AS (SELECT user_id, CASE WHEN count(gap) = 0 THEN 0 ELSE least(1, greatest(0, 1 - stddev_pop(gap) / (avg(gap) + 1e-6))) END AS dance FROM g GROUP BY 1),
 b AS (SELECT user_id, event_id % 12 AS bin, avg(value / 500) AS m FROM events GROUP BY 1, 2),
 v AS (SELECT user_id, CASE WHEN count(m) > 0 THEN least(1, greatest(0, (coalesce(avg(m) FILTER (bin IN (0, 4, 7)), 0)
   - coalesce(avg(m) FILTER (bin IN (0, 3, 7)), 0) + 1) / 2)) END AS valence FROM b GROUP BY 1),
 e AS (SELECT user_id, avg(value * 1.5) FILTER (event_id % 3 = 0) AS raw, avg(value / 1000) AS energy, stddev_pop(value / 1000) AS energy_std,
   avg(value * 3) AS centroid, avg(event_id % 50) AS bandwidth, avg(value + event_id % 50) AS rolloff, avg(event_id % 9) AS contrast, avg(event_id % 7) AS zcr,
   avg(value / 500) AS chroma_mean, stddev_pop(value / 500) AS chroma_std, count(value) AS n,
   coalesce(avg(value) FILTER ((event_id % 40) * 25 < 500), 0) AS lo, coalesce(avg(value) FILTER ((event_id % 40) * 25 >= 500), 0) AS hi,
   """ + ", ".join(f"avg(value) FILTER (event_id % 13 = {i}) AS m{i}" for i in range(13)) + """ FROM events GROUP BY 1)
 SELECT e.user_id AS track, round(CASE WHEN raw > 150 AND energy <= 0.25 THEN raw / 2 WHEN raw < 90 AND energy > 0.20 THEN raw * 2 ELSE raw END, 6) AS tempo,
  round(energy, 6) AS energy_mean, round(energy_std, 6) AS energy_std, round(valence, 6) AS valence_proxy, round(dance, 6) AS danceability_proxy,
  round(CASE WHEN n > 0 THEN lo / (lo + hi + 1e-6) END, 6) AS acousticness_proxy, round(centroid, 6) AS spectral_centroid, round(bandwidth, 6) AS spectral_bandwidth,
  round(rolloff, 6) AS spectral_rolloff, round(contrast, 6) AS spectral_contrast, round(zcr, 6) AS zcr, round(chroma_mean, 6) AS chroma_mean, round(chroma_std, 6) AS chroma_std,
  """ + ", ".join(f"round(m{i}, 6) AS mfcc_{i + 1}" for i in range(13)) + " FROM e JOIN v ON v.user_id IS NOT DISTINCT FROM e.user_id JOIN d ON d.user_id IS NOT DISTINCT FROM e.user_id")
def feature_rows(spark, sf):
    rows, n = _events(spark, sf), F.col("event_id")
    value = F.col("value")
    out = A.feature_rows(
        rows.filter(n % 3 == 0).select("track", (value * 1.5).alias("tempo")),
        rows.select("track", (value / 1000).alias("rms"), (value * 3).alias("centroid"), (n % 50).alias("bandwidth"), (value + n % 50).alias("rolloff"),
                    (n % 9).alias("contrast"), (n % 7).alias("zcr")),
        rows.select("track", (n % 13).alias("bin"), "value"), rows.select("track", (n % 12).alias("bin"), (value / 500).alias("value")),
        rows.select("track", F.col("ts").cast("timestamp").cast("double").alias("beat_time")),
        rows.select("track", ((n % 40) * 25).alias("freq"), value.alias("magnitude")))
    return out.select("track", *[F.round(c, 6).alias(c) for c in out.columns if c != "track"])


# --- pairs and classifier ----------------------------------------------------------------------------

def _positions_sql(seed):
    return f"(SELECT id, label, row_number() OVER (ORDER BY md5('{seed}|' || id), id) - 1 AS pos FROM songs)"


POSITIVE = f""" , pp AS (SELECT d.draw, n.src AS a, n.dst AS b FROM (
   SELECT draw, floor({u01("'positive-pos|' || draw")} * (SELECT count(*) FROM songs))::BIGINT AS pos,
    floor({u01("'positive-pick|' || draw")} * 3)::BIGINT + 1 AS pick FROM (SELECT unnest(range(0, {PAIRS})) AS draw)) d
  JOIN {_positions_sql('positive-order')} p ON p.pos = d.pos JOIN nn n ON n.src = p.id AND n.rank = d.pick)"""
NEGATIVE = f""" , byc AS (SELECT id, label, row_number() OVER (ORDER BY label, md5('negative-order|' || id), id) - 1 AS pos FROM songs),
 cl AS (SELECT label, count(*) AS size, min(pos) AS first FROM byc GROUP BY label),
 da AS (SELECT draw, c.id AS a, size, first FROM (
   SELECT draw, floor({u01("'negative-a|' || draw")} * (SELECT count(*) FROM songs))::BIGINT AS pos FROM (SELECT unnest(range(0, {PAIRS})) AS draw)) d
  JOIN byc c USING (pos) JOIN cl USING (label)),
 db AS (SELECT *, floor({u01("'negative-b|' || draw")} * ((SELECT count(*) FROM songs) - size))::BIGINT AS r FROM da),
 np AS (SELECT draw, a, c.id AS b FROM db JOIN byc c ON c.pos = CASE WHEN r < first THEN r ELSE r + size END)"""


@query("positive_pairs", POSITIVE + " SELECT * FROM pp", ("nn",))
def positive_pairs(spark, sf):
    return R.positive_pairs(fx.vectors(spark, sf), None, PAIRS)


@query("negative_pairs", NEGATIVE + " SELECT * FROM np", ("songs",))
def negative_pairs(spark, sf):
    return R.negative_pairs(fx.vectors(spark, sf), PAIRS, label="label")


def _pairs(spark, sf):
    return R.balance_shuffle(positive_pairs(spark, sf), negative_pairs(spark, sf))


@query("balance_shuffle", POSITIVE + NEGATIVE + """
 SELECT draw, a, b, label, row_number() OVER (ORDER BY md5('shuffle|' || label || '|' || draw), label, draw) - 1 AS row_id
 FROM (SELECT *, 1 AS label FROM pp UNION ALL SELECT *, 0 FROM np)""", ("nn",))
def balance_shuffle(spark, sf):
    return _pairs(spark, sf)


@query("pair_features", NEGATIVE + """
 , w AS (SELECT id, list(score ORDER BY label_id) AS v FROM moods GROUP BY id),
 f AS (SELECT np.draw, list_concat(a.emb, b.emb, [b.tempo - a.tempo, b.energy - a.energy, b.valence - a.valence], wa.v, wb.v) AS f
  FROM np JOIN songs a ON a.id = np.a JOIN songs b ON b.id = np.b JOIN w wa ON wa.id = np.a JOIN w wb ON wb.id = np.b)
 SELECT draw, (pos - 1)::INTEGER AS pos, round(f[pos], 5) + 0.0 AS x FROM (SELECT draw, f, unnest(range(1, len(f) + 1)) AS pos FROM f)""", ("moods",))
def pair_features(spark, sf):
    rows = X.pair_features(negative_pairs(spark, sf), fx.profiles(spark, sf))
    return rows.select("draw", F.posexplode("features").alias("pos", "x")).withColumn("x", tidy(F.col("x"), 5))


@query("pair_stats", POSITIVE + NEGATIVE + """
 SELECT (SELECT count(*) FROM pp) + (SELECT count(*) FROM np) AS rows, (SELECT count(*) FROM pp) AS positives,
  (SELECT count(*) FROM np) AS negatives, (131 + 2 * (SELECT count(*) FROM names))::INTEGER AS dim""", ("nn", "names"))
def pair_stats(spark, sf):
    return R.pair_stats(X.pair_features(_pairs(spark, sf), fx.profiles(spark, sf)))


_FITTED: dict = {}


def _trained(spark, sf):
    """A classifier for ``TRAIN_PAIRS`` drawn pairs of each kind: the bound of its labelled rows.

    It is fitted once per application and table, saved, and loaded again by whoever needs it.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        split, model, history = _fit(spark, sf)
        _FITTED[key] = split, save_model(model, spark, "transition-model"), store(history, "history")
    split, path, history = _FITTED[key]
    return split, load_transition_model(path), history


def _fit(spark, sf):
    songs = fx.vectors(spark, sf)
    drawn = R.balance_shuffle(R.positive_pairs(songs, None, TRAIN_PAIRS), R.negative_pairs(songs, TRAIN_PAIRS, label="label"))
    rows = store(X.pair_features(drawn, fx.profiles(spark, sf)), "pair-features")
    split = store(C.train_val_test_split(rows, "split", ["row_id"]), "split-pairs")
    return split, *T.train_transition_model(split, steps=5)


@query("train_transition_model")
def train_transition_model(spark, sf):
    _, _, history = _trained(spark, sf)
    return history


@query("score_transition_model")
def score_transition_model(spark, sf):
    split, model, _ = _trained(spark, sf)
    scored = T.model_scores(model, split.filter("split = 'test'").drop("features").join(
        split.select("row_id", "features"), "row_id"))
    metrics = T.classifier_metrics(scored)
    return metrics.withColumn("auc", T.roc_auc(scored).select("auc").scalar())


@query("score_transition", NEGATIVE + """
 SELECT np.draw, np.a, np.b, round(list_dot_product(a.emb, b.emb) / ((sqrt(list_dot_product(a.emb, a.emb)) + 1e-8) * (sqrt(list_dot_product(b.emb, b.emb)) + 1e-8)), 6) + 0.0 AS score
 FROM np JOIN songs a ON a.id = np.a JOIN songs b ON b.id = np.b""", ("songs",))
def score_transition(spark, sf):
    pairs = negative_pairs(spark, sf)
    return T.score_transition(pairs, fx.vectors(spark, sf)).select("draw", "a", "b", tidy(F.col("score"), 6).alias("score"))


@query("classifier_metrics", """
 SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1
 FROM (SELECT count(*) FILTER (label <> 1 AND score <= 0.5) AS tn, count(*) FILTER (label <> 1 AND score > 0.5) AS fp,
  count(*) FILTER (label = 1 AND score <= 0.5) AS fn, count(*) FILTER (label = 1 AND score > 0.5) AS tp FROM preds)""", ("preds",))
def classifier_metrics(spark, sf):
    out = T.classifier_metrics(fx.predictions(spark, sf))
    return out.select("tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("roc_auc", """
 , s AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM preds GROUP BY score),
 c AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
 SELECT round((sum(p * (below + n / 2)) / (sum(p)::DOUBLE * sum(n)))::DOUBLE, 6) AS auc FROM c""", ("preds",))
def roc_auc(spark, sf):
    return T.roc_auc(fx.predictions(spark, sf)).select(F.round("auc", 6).alias("auc"))


@query("bce_loss", """
 SELECT round(avg(-(label * CASE WHEN score > 0 THEN greatest(ln(CASE WHEN score > 0 THEN score ELSE 1 END), -100) ELSE -100 END
  + (1 - label) * CASE WHEN score < 1 THEN greatest(ln(CASE WHEN score < 1 THEN 1 - score ELSE 1 END), -100) ELSE -100 END)), 6) AS bce FROM preds""", ("preds",))
def bce_loss(spark, sf):
    return T.bce_loss(fx.predictions(spark, sf)).select(F.round("bce", 6).alias("bce"))


@query("best_epoch", """
 SELECT epoch, val_loss FROM (SELECT user_id AS epoch, round(avg(value), 6) AS val_loss FROM events GROUP BY user_id)
 QUALIFY row_number() OVER (ORDER BY val_loss, epoch) = 1""")
def best_epoch(spark, sf):
    history = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("val_loss"))
    return T.best_epoch(history)


# --- playlists -----------------------------------------------------------------------------------------

CAND_COLS = ["request_id", "nth", "id", "source", "mood_score", "graph_score", "direct"]


def _cands(df):
    return df.select("request_id", "nth", "id", "source", F.round("mood_score", 6).alias("mood_score"), "graph_score",
                     tidy(F.col("direct"), 6).alias("direct"))


TIERS = """
 , loose AS (SELECT * FROM near WHERE mood_score > 0.15 AND (wanted IS NULL OR wanted = language)),
 g AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY mood_score DESC, id) AS nth FROM loose WHERE graph_score IS NOT NULL QUALIFY nth <= 30),
 n AS (SELECT * REPLACE (NULL::DOUBLE AS graph_score), row_number() OVER (PARTITION BY request_id ORDER BY mood_score DESC, id) AS nth FROM loose QUALIFY nth <= 60),
 draws AS (SELECT s.request_id, s.mood, s.wanted, p.id, p.n, row_number() OVER (PARTITION BY s.request_id ORDER BY md5('{seed}-cut|' || s.request_id || '|' || p.id)) AS cut
  FROM states s JOIN pools p ON p.mood = s.mood WHERE p.id <> s.request_id AND p.n <= 181),
 pool AS (SELECT d.request_id, d.id, m.score AS mood_score, x.language, d.wanted, row_number() OVER (PARTITION BY d.request_id ORDER BY m.score DESC, d.id) AS nth
  FROM draws d JOIN songs x ON x.id = d.id JOIN moods m ON m.id = d.id AND m.label_id = d.mood
  WHERE d.cut <= 180 AND (d.wanted IS NULL OR d.wanted = x.language) QUALIFY nth <= 60)"""


@query("candidates_graph", TIERS.format(seed="global") + """
 SELECT request_id, nth::INTEGER AS nth, id, 'graph' AS source, mood_score, graph_score, round(direct, 6) + 0.0 AS direct FROM g""", ("near", "pools"))
def candidates_graph(spark, sf):
    return _cands(P.candidates_graph(fx.states(spark, sf), fx.neighbours(spark, sf)))


@query("candidates_ann", TIERS.format(seed="global") + """
 SELECT request_id, nth::INTEGER AS nth, id, 'near' AS source, mood_score, graph_score, round(direct, 6) + 0.0 AS direct FROM n""", ("near", "pools"))
def candidates_ann(spark, sf):
    return _cands(P.candidates_ann(fx.states(spark, sf), fx.neighbours(spark, sf)))


# Pools of the test tables hold at most 181 songs, so a draw is the whole pool in SQL too.
@query("candidates_global", TIERS.format(seed="global") + """
 SELECT p.request_id, p.nth::INTEGER AS nth, p.id, 'pool' AS source, p.mood_score, NULL::DOUBLE AS graph_score,
  round(list_dot_product(a.emb, b.emb) / ((sqrt(list_dot_product(a.emb, a.emb)) + 1e-8) * (sqrt(list_dot_product(b.emb, b.emb)) + 1e-8)), 6) + 0.0 AS direct
 FROM pool p JOIN songs a ON a.id = p.request_id JOIN songs b ON b.id = p.id""", ("near", "pools"))
def candidates_global(spark, sf):
    pools, sizes = fx.pools(spark, sf)
    spots = fx.vectors(spark, sf).select(F.col("id").alias("current"), F.col("embedding").cast("array<double>").alias("current_vec"))
    return _cands(P.candidates_global(fx.states(spark, sf), spots, pools, sizes))


@query("candidates_tiered", TIERS.format(seed="tier-pool") + """
 , cg AS (SELECT s.request_id, count(g.id) AS c FROM states s LEFT JOIN g USING (request_id) GROUP BY 1),
 local AS (SELECT request_id, id, 'graph' AS source, mood_score, graph_score FROM g UNION ALL
  SELECT n.request_id, n.id, 'near', n.mood_score, NULL FROM n JOIN cg ON cg.request_id = n.request_id AND cg.c < 3
  WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.request_id = n.request_id AND g.id = n.id)),
 cl AS (SELECT s.request_id, count(l.id) AS c FROM states s LEFT JOIN local l USING (request_id) GROUP BY 1)
 SELECT * FROM local UNION ALL SELECT p.request_id, p.id, 'pool', p.mood_score, NULL FROM pool p JOIN cl ON cl.request_id = p.request_id AND cl.c < 3
 WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.request_id = p.request_id AND l.id = p.id)""", ("near", "pools"))
def candidates_tiered(spark, sf):
    pools, sizes = fx.pools(spark, sf)
    out = P.candidates_tiered(fx.states(spark, sf), fx.neighbours(spark, sf), pools, sizes)
    return out.select("request_id", "id", "source", F.round("mood_score", 6).alias("mood_score"), "graph_score")


@query("bridge_candidates", """
 , has AS (SELECT s.request_id, count(n.id) FILTER (n.graph_score IS NOT NULL) AS c FROM states s LEFT JOIN near n USING (request_id) GROUP BY 1),
 b AS (SELECT n.request_id, n.id, (mood_score + next_score) / 2 AS mood_score, CASE WHEN has.c > 0 THEN graph_score END AS graph_score
  FROM near n JOIN has USING (request_id) WHERE mood_score > 0.4 AND next_score > 0.4 AND ((has.c > 0 AND graph_score IS NOT NULL) OR (has.c = 0 AND rank < 120))),
 p AS (SELECT s.request_id, x.id, (m.score + m2.score) / 2 AS mood_score FROM states s JOIN idx x ON x.mood = s.mood JOIN idx y ON y.mood = s.next_mood AND y.id = x.id
  JOIN moods m ON m.id = x.id AND m.label_id = s.mood JOIN moods m2 ON m2.id = x.id AND m2.label_id = s.next_mood
  WHERE x.id <> s.request_id AND m.score > 0.4 AND m2.score > 0.4 AND s.request_id NOT IN (SELECT request_id FROM b))
 SELECT request_id, id, 'bridge' AS source, round(mood_score, 6) AS mood_score, graph_score FROM b
 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY mood_score DESC, id) <= 30
 UNION ALL SELECT request_id, id, 'bridge', round(mood_score, 6), NULL FROM p QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY mood_score DESC, id) <= 30""", ("near", "idx"))
def bridge_candidates(spark, sf):
    pools, sizes = fx.pools(spark, sf)
    out = P.bridge_candidates(fx.states(spark, sf), fx.neighbours(spark, sf), pools, sizes)
    return out.select("request_id", "id", "source", F.round("mood_score", 6).alias("mood_score"), "graph_score")


@query("parse_candidate", """
 SELECT t.request_id, m.id, 'loose' AS rule, m.score AS mood_score FROM states t JOIN moods m ON m.label_id = t.mood AND m.id = t.next_id JOIN songs s ON s.id = m.id
 WHERE m.score > 0.15 AND (t.wanted IS NULL OR t.wanted = s.language) UNION ALL
 SELECT t.request_id, i.id, 'dominant', i.score FROM states t JOIN idx i ON i.mood = t.mood AND i.id = t.next_id JOIN songs s ON s.id = i.id
 WHERE t.wanted IS NULL OR t.wanted = s.language""".replace("states t", "(SELECT *, request_id + 1 AS next_id FROM states) t"), ("states", "moods", "idx"))
def parse_candidate(spark, sf):
    from arcloom.operators.moods import parse_candidate as parse

    nxt = fx.profiles(spark, sf).select((F.col("id") - 1).alias("request_id"), "id", "scores", "language")
    cands = fx.states(spark, sf).select("request_id", "mood", "wanted").join(nxt, "request_id")
    parts = [parse(cands, strict).select("request_id", "id", F.lit(name).alias("rule"), "mood_score")
             for strict, name in ((False, "loose"), (True, "dominant"))]
    return parts[0].unionByName(parts[1])


def _scored(spark, sf):
    """Every song's 20 nearest as its candidates."""
    near = N.knn_l2(fx.vectors(spark, sf), 20)
    return near.select(F.col("src").alias("request_id"), F.col("dst").alias("id"),
                       F.when(F.col("cosine") >= 0.3, tidy(F.col("cosine"), 4)).alias("graph_score"),
                       F.col("cosine").alias("direct"))


CANDS = """ , c AS (SELECT src AS request_id, dst AS id, CASE WHEN cosine >= 0.3 THEN round(cosine, 4) END AS graph_score,
  cosine AS direct, coalesce(CASE WHEN cosine >= 0.3 THEN round(cosine, 4) END, cosine) AS transition FROM nn WHERE rank <= 20)"""


@query("score_candidates", CANDS + " SELECT request_id, id, round(transition, 8) + 0.0 AS transition, round(direct, 8) + 0.0 AS recomputed FROM c", ("nn",))
def score_candidates(spark, sf):
    both = P.score_candidates(_scored(spark, sf)).withColumnRenamed("transition", "kept")
    return P.score_candidates(both, "service").select(
        "request_id", "id", tidy(F.col("kept"), 8).alias("transition"), tidy(F.col("transition"), 8).alias("recomputed"))


DIMS, MOODS = 64, 10
#: Fixed weights of a logistic score over all pair features, so that SQL can say it too.
LINEAR = [((37 * i) % 11 - 5) / 10 for i in range(2 * DIMS + 3 + 2 * MOODS)]
LINEAR_BIAS = 0.25
LINEAR_SQL = """ , mv AS (SELECT id, list(score ORDER BY label_id) AS v FROM moods GROUP BY id),
 lw AS (SELECT [((37 * i) % 11 - 5) / 10.0 FOR i IN range(0, 151)]::DOUBLE[] AS w)"""


def _linear_score(a, b):
    return f"""1 / (1 + exp(-({LINEAR_BIAS}::DOUBLE + list_dot_product((SELECT w FROM lw), list_concat({a}.emb, {b}.emb,
  [{b}.tempo - {a}.tempo, {b}.energy - {a}.energy, {b}.valence - {a}.valence], m{a}.v, m{b}.v)))))"""


def _network():
    return S.linear_network(DIMS, LINEAR, LINEAR_BIAS)


@query("score_candidates_model", CANDS + LINEAR_SQL + f"""
 , p AS (SELECT c.*, {_linear_score("a", "b")} AS model FROM c JOIN songs a ON a.id = c.request_id JOIN songs b ON b.id = c.id JOIN mv ma ON ma.id = a.id JOIN mv mb ON mb.id = b.id)
 SELECT request_id, id, round(coalesce(graph_score, model), 8) + 0.0 AS transition, round(model, 8) + 0.0 AS recomputed FROM p""", ("nn", "moods"))
def score_candidates_model(spark, sf):
    songs = store(fx.profiles(spark, sf), "profiles")
    scorer = S.pair_scorer(songs, _network())
    cands = store(_scored(spark, sf).withColumn("current", F.col("request_id")), "candidates")
    kept = P.score_candidates(cands, "batch", scorer).withColumnRenamed("transition", "kept")
    return P.score_candidates(kept, "service", scorer).select(
        "request_id", "id", tidy(F.col("kept"), 8).alias("transition"), tidy(F.col("transition"), 8).alias("recomputed"))


@query("exclude_played", " SELECT src AS request_id, dst AS id FROM nn WHERE rank BETWEEN 4 AND 20", ("nn",))
def exclude_played(spark, sf):
    near = N.knn_l2(fx.vectors(spark, sf), 20).select(F.col("src").alias("request_id"), F.col("dst").alias("id"), "rank")
    return P.exclude_played(near, near.filter("rank <= 3")).select("request_id", "id")


@query("merge_candidates", """
 SELECT src AS request_id, dst AS id, CASE WHEN rank <= 6 THEN 1 ELSE 2 END::INTEGER AS tier FROM nn WHERE rank <= 12""", ("nn",))
def merge_candidates(spark, sf):
    near = N.knn_l2(fx.vectors(spark, sf), 12).select(F.col("src").alias("request_id"), F.col("dst").alias("id"), "rank")
    return P.merge_candidates(near.filter("rank <= 6"), near.filter("rank > 3")).select("request_id", "id", "tier")


BLENDED = CANDS + """ , z AS (SELECT c.request_id, c.id, (1 - 0.55) * c.transition + 0.55 * m.score AS score
  FROM c JOIN songs s ON s.id = c.request_id JOIN moods m ON m.id = c.id AND m.label_id = s.label)"""


def _blended(spark, sf):
    mood = fx.bare_profiles(spark, sf).select("id", "scores")
    owner = fx.vectors(spark, sf).select(F.col("id").alias("request_id"), "label")
    cands = P.score_candidates(_scored(spark, sf)).join(mood, "id").join(owner, "request_id").withColumns({
        "mood_score": F.element_at("scores", F.col("label") + 1), "alpha": F.lit(0.55)})
    return P.blend_scores(cands).select("request_id", "id", "score")


@query("blend_scores", BLENDED + " SELECT request_id, id, round(score, 8) + 0.0 AS score FROM z", ("nn", "moods"))
def blend_scores(spark, sf):
    return _blended(spark, sf).withColumn("score", tidy(F.col("score"), 8))


@query("median_cap", BLENDED + """
 SELECT z.request_id, z.id, round(CASE WHEN m.med > 0 THEN least(z.score, 1.5 * m.med) ELSE z.score END, 8) + 0.0 AS score
 FROM z JOIN (SELECT request_id, median(score) AS med FROM z GROUP BY 1) m USING (request_id)""", ("nn", "moods"))
def median_cap(spark, sf):
    return P.median_cap(_blended(spark, sf)).select("request_id", "id", tidy(F.col("score"), 8).alias("score"))


@query("sqrt_damp", BLENDED + """
 , t AS (SELECT request_id, max(score) AS hi, list_sort(list(score), 'DESC')[2] AS second FROM z GROUP BY 1)
 SELECT z.request_id, z.id, round(CASE WHEN t.hi > 2 * t.second THEN sqrt(greatest(z.score, 0)) ELSE z.score END, 8) + 0.0 AS score FROM z JOIN t USING (request_id)""", ("nn", "moods"))
def sqrt_damp(spark, sf):
    return P.sqrt_damp(_blended(spark, sf)).select("request_id", "id", tidy(F.col("score"), 8).alias("score"))


@query("softmax_probs", BLENDED + """
 , e AS (SELECT request_id, id, exp((score - max(score) OVER (PARTITION BY request_id)) / 0.1) AS e FROM z)
 SELECT request_id, id, round(e / sum(e) OVER (PARTITION BY request_id), 6) AS prob FROM e""", ("nn", "moods"))
def softmax_probs(spark, sf):
    return P.softmax_probs(_blended(spark, sf), F.lit(0.1)).select("request_id", "id", F.round("prob", 6).alias("prob"))


@query("softmax_sample", BLENDED + f"""
 , k AS (SELECT request_id, id, score, round(score / 0.1 - ln(-ln(greatest({u01("'draw|' || request_id || '|' || id")}, 1e-12))), 9) AS key FROM z)
 SELECT request_id, id, round(score, 8) + 0.0 AS score FROM k QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY key DESC, id DESC) = 1""", ("nn", "moods"))
def softmax_sample(spark, sf):
    return P.softmax_sample(_blended(spark, sf), F.lit(0.1), "draw").select("request_id", "id", tidy(F.col("score"), 8).alias("score"))


ZONES = """ SELECT request_id, zone::INTEGER AS zone, arc[zone + 1] AS mood, (base + CASE WHEN zone < total - base * n THEN 1 ELSE 0 END)::INTEGER AS zone_len,
  round(0.4 + 0.3 * zone / greatest(n - 1, 1), 6) AS alpha, '{name}' AS profile FROM (
   SELECT *, len(arc) AS n, playlist_len - {less} AS total, (playlist_len - {less}) // len(arc) AS base, unnest(range(0, len(arc))) AS zone FROM requests)"""


@query("zone_plan", ZONES.format(name="batch", less=1) + " UNION ALL " + ZONES.format(name="service", less=0), ("requests",))
def zone_plan(spark, sf):
    parts = [P.zone_plan(fx.requests(spark, sf), p).withColumns({"alpha": F.round("alpha", 6), "profile": F.lit(p)})
             for p in ("batch", "service")]
    return parts[0].unionByName(parts[1]).select("request_id", "zone", "mood", "zone_len", "alpha", "profile")


@query("seed_random", f"""
 , m AS (SELECT p.mood, p.id, coalesce(s.language, 'en') AS lang FROM pools p JOIN songs s ON s.id = p.id),
 f AS (SELECT mood, lang, id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY mood, lang) AS n
  FROM (SELECT * FROM m UNION ALL SELECT mood, id, '' FROM m) WINDOW w AS (PARTITION BY mood, lang ORDER BY md5('seed-order|' || id), id)),
 r2 AS (SELECT request_id, spots[1] AS mood, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.mood = spots[1] AND m.lang = wanted) THEN wanted ELSE '' END AS lang FROM requests)
 SELECT r.request_id, coalesce(f.id, (SELECT min(id) FROM songs)) AS id FROM r2 r LEFT JOIN f ON f.mood = r.mood AND f.lang = r.lang
  AND f.pos = least(floor({u01("'seed-pick|' || r.request_id")} * f.n), f.n - 1)""", ("requests", "pools"))
def seed_random(spark, sf):
    pools, sizes = fx.pools(spark, sf)
    return P.seed_random(fx.placed_requests(spark, sf), pools, sizes, fx.vectors(spark, sf))


STEP_SQL = TIERS.format(seed="walk-pool").replace("FROM near", "FROM steps_near") + """
 , cg AS (SELECT s.request_id, count(g.id) AS c FROM states s LEFT JOIN g USING (request_id) GROUP BY 1),
 local AS (SELECT request_id, id, 'graph' AS source, mood_score, graph_score FROM g UNION ALL
  SELECT n.request_id, n.id, 'near', n.mood_score, NULL FROM n JOIN cg ON cg.request_id = n.request_id AND cg.c < 3
  WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.request_id = n.request_id AND g.id = n.id)),
 cl AS (SELECT s.request_id, count(l.id) AS c FROM states s LEFT JOIN local l USING (request_id) GROUP BY 1),
 cands AS (SELECT * FROM local UNION ALL SELECT p.request_id, p.id, 'pool', p.mood_score, NULL FROM pool p JOIN cl ON cl.request_id = p.request_id AND cl.c < 3
  WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.request_id = p.request_id AND l.id = p.id)),
 scored AS (SELECT c.request_id, c.id, c.source, 0.6::DOUBLE * {transition} + 0.4::DOUBLE * c.mood_score AS score FROM cands c
  JOIN songs a ON a.id = c.request_id JOIN songs b ON b.id = c.id JOIN mv ma ON ma.id = a.id JOIN mv mb ON mb.id = b.id),
 listed AS (SELECT request_id, list_sort(list(score)) AS all_, median(score) AS med, count(*) AS n FROM scored GROUP BY 1),
 flat AS (SELECT s.*, {flat} AS heat_score FROM scored s JOIN listed l USING (request_id)),
 keyed AS (SELECT *, round(heat_score / {heat} - ln(-ln(greatest({u}, 1e-12))), 9) AS key FROM flat)
 SELECT request_id, id, source, round(score, 8) + 0.0 AS score, '{profile}' AS profile FROM keyed
 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY key DESC, id DESC) = 1"""


def _step_sql(profile: str) -> str:
    model = _linear_score("a", "b")
    text = STEP_SQL
    if profile == "service":
        # The order of distance instead of mood, fewer songs looked at, and the graph cut before the mood filter.
        text = text.replace("ORDER BY mood_score DESC, id) AS nth FROM loose WHERE graph_score IS NOT NULL QUALIFY nth <= 30", "ORDER BY rank) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS e FROM steps_near WHERE graph_score IS NOT NULL QUALIFY e <= 30) WHERE mood_score > 0.15 AND (wanted IS NULL OR wanted = language)")
        text = text.replace("ORDER BY mood_score DESC, id) AS nth FROM loose QUALIFY nth <= 60", "ORDER BY rank) AS nth FROM loose WHERE rank < 70 QUALIFY nth <= 60")
        text = text.replace("ORDER BY m.score DESC, d.id) AS nth", "ORDER BY d.cut) AS nth").replace("d.cut <= 180", "d.cut <= 60")
    values = {
        "transition": f"coalesce(c.graph_score, {model})" if profile == "batch" else model, "profile": profile,
        "flat": "CASE WHEN l.med > 0 THEN least(s.score, 1.5::DOUBLE * l.med) ELSE s.score END" if profile == "batch"
        else "CASE WHEN l.n > 1 AND l.all_[l.n] > 2 * l.all_[l.n - 1] THEN sqrt(greatest(s.score, 0)) ELSE s.score END",
        "heat": "(0.3::DOUBLE + 1e-8::DOUBLE)" if profile == "batch" else "0.3::DOUBLE",
        "u": u01("'walk-draw|' || request_id || '|0|1|' || id")}
    for name, value in values.items():
        text = text.replace("{" + name + "}", value)
    return text


STEPS_NEAR = LINEAR_SQL + f""" , steps_near AS (SELECT n.* EXCLUDE (graph_score), CASE WHEN n.rank <= 50 AND x.model >= 0.3::DOUBLE THEN round(x.model, 4) END AS graph_score FROM near n JOIN (
  SELECT n.request_id, n.id, {_linear_score("a", "b")} AS model FROM near n JOIN songs a ON a.id = n.request_id JOIN songs b ON b.id = n.id
  JOIN mv ma ON ma.id = a.id JOIN mv mb ON mb.id = b.id) x ON x.request_id = n.request_id AND x.id = n.id)"""


def _walk_tables(spark, sf, network):
    """Neighbours scored by a network, pools of song states, and the scorer of songs that are drawn."""
    songs = store(fx.profiles(spark, sf), "profiles")
    states = songs.withColumn("embedding", S.state_of())
    lists = G.scored_neighbours(songs.select("id", "embedding"), P.NEAREST_KEPT, S.pair_scorer(songs, network))
    pools = store(mood_pools(states.select("id", "embedding", "language", "scores", "mood_ids")), "pools")
    return P.neighbour_table(lists, states), pools, store(pool_sizes(pools), "pool-sizes"), S.state_scorer(spark, network)


@query("walk_step", STEPS_NEAR + f" SELECT * FROM ({_step_sql('batch').replace(' , loose', 'WITH loose', 1)}) UNION ALL SELECT * FROM ({_step_sql('service').replace(' , loose', 'WITH loose', 1)})",
       ("near", "pools"))
def walk_step(spark, sf):
    """Every song's first step towards the next two moods on the wheel, scored by a fixed network, in both profiles."""
    near, pools, sizes, scorer = _walk_tables(spark, sf, _network())
    (near, held), pools = store_by_key(near, "neighbours", "current"), store(P.salted_pools(pools), "salted-pools")
    asked = fx.states(spark, sf).select("request_id", "current", F.array("mood", "next_mood").alias("arc"), F.lit(0.3).alias("temperature"),
                                        F.lit(8).alias("playlist_len"), "wanted")
    parts = []
    for profile in P.PROFILES.values():
        start = P.walk_start(asked.drop("current"), asked.select("request_id", F.col("current").alias("id")), profile)
        step = store(P.walk_step(start, near, pools, sizes, profile, "walk", scorer=scorer), "walk-step").filter(F.size("picks") > 0)
        pick = F.element_at("picks", 1)
        parts.append(step.select("request_id", pick["id"].alias("id"), pick["source"].alias("source"), tidy(pick["score"], 8).alias("score"), F.lit(profile.name).alias("profile")))
    spark.sql(f"DROP TABLE IF EXISTS {held}")
    return parts[0].unionByName(parts[1])


def _walk(spark, sf, profile="batch"):
    pools, _ = fx.pools(spark, sf)
    asked = fx.placed_requests(spark, sf)
    seeds = asked.select("request_id", F.col("seed_id").alias("id"))
    pools = store(pools, "pools")
    return P.generate_playlists(asked, seeds, fx.neighbours(spark, sf), pools, store(pool_sizes(pools), "pool-sizes"), profile)


@query("generate_playlists")
def generate_playlists(spark, sf):
    return _walk(spark, sf).withColumn("score", F.round("score", 6))


@query("generate_playlists_service")
def generate_playlists_service(spark, sf):
    return _walk(spark, sf, "service").withColumn("score", F.round("score", 6))


@query("resolve_requests", f"""
 , asked AS (SELECT r.request_id, r.spots, r.wanted, CASE WHEN s.id % 8 = 0 THEN s.id + 1000000 WHEN s.id % 4 = 0 THEN s.id END AS seed_id,
   CASE s.id % 4 WHEN 1 THEN s.artist WHEN 2 THEN 'qqxx' END AS seed_query FROM requests r JOIN songs s ON s.id = r.request_id),
 staged AS (SELECT *, CASE WHEN seed_id IS NOT NULL THEN 'id' WHEN coalesce(seed_query, '') <> '' THEN 'text' ELSE 'random' END AS stage FROM asked),
 q AS (SELECT request_id, lower(seed_query) AS text FROM staged WHERE stage = 'text'),
 st AS (SELECT request_id, text AS term, 0 AS word_pos, 1 AS nth FROM q UNION ALL SELECT request_id, text, 0, 2 FROM q UNION ALL
  SELECT request_id, w, p, 3 FROM (SELECT request_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM q) WHERE length(w) >= 2),
 hits AS (SELECT t.term, min(s.id) FILTER (contains(lower(s.name), t.term)) AS by_name, min(s.id) FILTER (contains(lower(s.artist), t.term)) AS by_artist, min(s.id) AS by_any
  FROM (SELECT DISTINCT term FROM st) t JOIN songs s ON contains(lower(s.name), t.term) OR contains(lower(s.artist), t.term) GROUP BY t.term),
 best AS (SELECT request_id, CASE nth WHEN 1 THEN by_name WHEN 2 THEN by_artist ELSE by_any END AS id FROM st JOIN hits USING (term)
  WHERE CASE nth WHEN 1 THEN by_name WHEN 2 THEN by_artist ELSE by_any END IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY nth, word_pos, id) = 1),
 m AS (SELECT p.mood, p.id, coalesce(s.language, 'en') AS lang FROM pools p JOIN songs s ON s.id = p.id),
 f AS (SELECT mood, lang, id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY mood, lang) AS n
  FROM (SELECT * FROM m UNION ALL SELECT mood, id, '' FROM m) WINDOW w AS (PARTITION BY mood, lang ORDER BY md5('seed-order|' || id), id)),
 r2 AS (SELECT request_id, spots[1] AS mood, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.mood = spots[1] AND m.lang = wanted) THEN wanted ELSE '' END AS lang FROM staged WHERE stage = 'random'),
 rnd AS (SELECT r.request_id, coalesce(f.id, (SELECT min(id) FROM songs)) AS id FROM r2 r LEFT JOIN f ON f.mood = r.mood AND f.lang = r.lang
  AND f.pos = least(floor({u01("'seed-pick|' || r.request_id")} * f.n), f.n - 1))
 SELECT t.request_id, coalesce(k.id, b.id, d.id) AS id, t.stage, coalesce(k.id, b.id, d.id) IS NOT NULL AS resolved FROM staged t
 LEFT JOIN songs k ON k.id = t.seed_id AND t.stage = 'id' LEFT JOIN best b ON b.request_id = t.request_id LEFT JOIN rnd d ON d.request_id = t.request_id""", ("requests", "pools"))
def resolve_requests(spark, sf):
    """A quarter of the requests names a song by id, half of these in vain, a quarter an artist, a quarter nonsense, the rest nothing."""
    songs = store(fx.songs(spark, sf), "songs")
    pools, sizes = fx.pools(spark, sf)
    rest = F.col("request_id") % 4
    asked = fx.placed_requests(spark, sf).drop("seed_id").join(songs.select(F.col("id").alias("request_id"), "artist"), "request_id").withColumns({
        "seed_id": F.when(F.col("request_id") % 8 == 0, F.col("request_id") + 1000000).when(rest == 0, F.col("request_id")),
        "seed_query": F.when(rest == 1, F.col("artist")).when(rest == 2, "qqxx")})
    return Q.resolve_requests(asked, songs, pools, sizes)


@query("playlist_rows", """
 , l AS (SELECT id, string_agg('mood_' || label_id || ':' || CAST(round(score * 10000) AS INTEGER), ' ' ORDER BY label_id) AS moods FROM moods GROUP BY id)
 SELECT n.src AS request_id, n.rank::INTEGER AS pos, n.dst AS id, s.name, s.artist, 'mood_' || r.label_id AS top_mood, l.moods FROM nn n
 JOIN songs s ON s.id = n.dst JOIN ranked r ON r.id = n.dst AND r.rank = 0 JOIN l ON l.id = n.dst WHERE n.rank <= 12""", ("nn", "ranked"))
def playlist_rows(spark, sf):
    rows = Q.playlist_rows(_listening(spark, sf), fx.songs(spark, sf), fx.bare_profiles(spark, sf), fx.labels(spark, sf))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("moods")), lambda e: F.concat(
        e["key"], F.lit(":"), F.round(e["value"] * 10000).cast("int").cast("string"))), " ")
    return rows.select("request_id", "pos", "id", "name", "artist", "top_mood", told.alias("moods"))


def _listening(spark, sf):
    """Each song's nearest songs as a finished playlist."""
    near = N.knn_l2(fx.vectors(spark, sf), 12)
    return near.select(F.col("src").alias("request_id"), F.col("rank").alias("pos"), F.col("dst").alias("id"),
                       F.col("dist").alias("score"))


@query("playlist_report", """
 , m AS (SELECT id, string_agg(label_id, ',' ORDER BY rank) AS moods FROM ranked WHERE rank < 2 GROUP BY id)
 SELECT n.src AS request_id, n.rank::INTEGER AS pos, n.dst AS id, m.moods, n.dist AS score, count(*) OVER (PARTITION BY n.src) AS n_songs,
  count(*) OVER (PARTITION BY n.src) < r.playlist_len AS short FROM nn n JOIN m ON m.id = n.dst JOIN requests r ON r.request_id = n.src WHERE n.rank <= 12""", ("nn", "ranked", "requests"))
def playlist_report(spark, sf):
    return P.playlist_report(_listening(spark, sf), fx.requests(spark, sf), fx.bare_profiles(spark, sf))


@query("arc_coverage", """
 , a AS (SELECT request_id, zone, spots[zone + 1] AS mood FROM (SELECT *, unnest(range(0, len(spots))) AS zone FROM requests))
 SELECT a.request_id, a.zone::INTEGER AS zone, a.mood::INTEGER AS mood, count(r.id) AS n FROM a LEFT JOIN nn n ON n.src = a.request_id AND n.rank <= 12
 LEFT JOIN ranked r ON r.id = n.dst AND r.rank = 0 AND r.label_id = a.mood GROUP BY ALL""", ("nn", "ranked", "requests"))
def arc_coverage(spark, sf):
    return P.arc_coverage(_listening(spark, sf), fx.placed_requests(spark, sf), fx.bare_profiles(spark, sf))
