"""Mood graph, song graph and cheapest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.functions.vectors import l2_distance, tidy
from arcloom.operators import held_paths
from arcloom.operators.neighbours import nearest
from arcloom.operators.vector_index import knn_approx
from arcloom.sources.workspace import cut_lineage, store

# Similarity thresholds, neighbour count, pruning bound, mood weight and path length.
START_THRESHOLD = 0.7
LOWER_THRESHOLDS = [0.6, 0.5, 0.4, 0.3, 0.2]
TOP_K, PRUNE_BELOW = 50, 0.3
MOOD_WEIGHT, MAX_STEPS = 0.4, 30
# Costs that are expanded together in a search for paths: about that of an edge.
BUCKET = 0.75


def mood_graph(similarity: DataFrame, labels: DataFrame, threshold: float = START_THRESHOLD) -> DataFrame:
    """Edges i < j whose unrounded similarity reaches the threshold, with both labels."""
    def named(side):
        return labels.select(F.col("label_id").alias(side), F.col("label").alias(f"{side}_label"))

    kept = similarity.filter(F.col("sim") >= threshold).select(
        F.col("i").alias("source"), F.col("j").alias("target"), F.round("sim", 4).alias("weight"))
    return kept.join(named("source"), "source").join(named("target"), "target").select(
        "source", "target", "weight", "source_label", "target_label")


def _both_ways(edges: DataFrame, *extra) -> DataFrame:
    ends = F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v")),
                   F.struct(F.col("target").alias("u"), F.col("source").alias("v")))
    return edges.select(F.explode(ends).alias("e"), *extra).select("e.u", "e.v", *extra)


def graph_connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ``reachable`` from the lowest id, breadth first; each round expands new nodes only."""
    links = store(_both_ways(edges).distinct(), "links")
    frontier = cut_lineage(nodes.agg(F.min("id").alias("id")))
    seen = frontier
    while not frontier.isEmpty():
        reached = frontier.join(links, frontier["id"] == links["u"]).select(F.col("v").alias("id")).distinct()
        frontier = cut_lineage(reached.join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier)
    return nodes.join(seen.withColumn("_seen", F.lit(True)), "id", "left").withColumn(
        "reachable", F.coalesce("_seen", F.lit(False))).drop("_seen")


def connectivity_report(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, whether all nodes are connected, and the isolated labels."""
    n_edges = edges.agg(F.count("*")).scalar()
    isolated = F.array_sort(F.collect_list(F.when(~F.col("reachable"), F.col("label"))))
    return reach.agg(
        F.count("*").alias("nodes"), F.count_if("reachable").alias("reached"),
        F.array_join(isolated, ", ").alias("isolated"),
    ).withColumn("connected", (F.col("nodes") == F.col("reached")) & (n_edges > 0))


def connection_strength(nodes: DataFrame, similarity: DataFrame) -> DataFrame:
    """``(id, strength)``: the best bottleneck similarity of any way from the lowest id.

    A node is reachable at threshold t exactly if its strength is at least t, so one relaxation answers
    every threshold.
    """
    links = store(_both_ways(similarity.select(F.col("i").alias("source"), F.col("j").alias("target"), "sim"), "sim"),
                  "similarity")
    low = nodes.agg(F.min("id")).scalar()
    state = cut_lineage(nodes.select("id", F.when(F.col("id") == low, 2.0).otherwise(-1.0).alias("strength")))
    changed = state.filter("strength > 0")
    while not changed.isEmpty():
        offers = changed.join(links, changed["id"] == links["u"]).groupBy(F.col("v").alias("id")).agg(
            F.max(F.least("strength", "sim")).alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("offer") > F.col("strength"))
        state = cut_lineage(state.join(offers, "id", "left").select(
            "id", F.when(better, F.col("offer")).otherwise(F.col("strength")).alias("strength"), better.alias("moved")))
        changed = state.filter("moved").select("id", "strength")
        state = state.select("id", "strength")
    return state


def auto_threshold(similarity: DataFrame, labels: DataFrame, start: float = START_THRESHOLD) -> DataFrame:
    """Mood graph at the first threshold that connects all nodes, else at the last one tried."""
    nodes = labels.select(F.col("label_id").alias("id"))
    weakest = connection_strength(nodes, similarity).agg(F.min("strength")).first()[0]
    tried = [start, *LOWER_THRESHOLDS]
    chosen = next((t for t in tried if weakest is not None and weakest >= t), tried[-1])
    return mood_graph(similarity, labels, chosen).withColumns({
        "threshold": F.lit(chosen), "connected": F.lit(weakest is not None and weakest >= chosen)})


def mood_graph_adjacency(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node the text ``label (w.ww), ...`` or ``none``."""
    two = F.array(
        F.struct(F.col("source").alias("label_id"), F.col("target_label").alias("other"), "weight"),
        F.struct(F.col("target").alias("label_id"), F.col("source_label").alias("other"), "weight"))
    lists = edges.select(F.explode(two).alias("e")).select("e.*").groupBy("label_id").agg(F.array_join(F.array_sort(
        F.collect_list(F.format_string("%s (%.2f)", "other", "weight"))), ", ").alias("text"))
    return labels.join(lists, "label_id", "left").select(
        "label_id", "label", F.coalesce("text", F.lit("none")).alias("connections"))


def scored_neighbours(songs: DataFrame, k: int = TOP_K, scorer=None, method: str = "exact", **search) -> DataFrame:
    """``(src, dst, rank, dist, score)`` for the ``k`` nearest songs; cosine unless a scorer is given.

    The neighbour search already holds both vectors, so the cosine costs no further join. ``method`` is ``exact``, whose work is
    quadratic where the vectors have no structure, or ``approximate``, the stored index with calibrated probes and the choice for
    catalogues of millions; ``queries`` restricts either to some songs.
    """
    if method not in ("exact", "approximate"):
        raise ValueError(f"no search method {method!r}")
    knn = (knn_approx if method == "approximate" else nearest)(songs, k, **search)
    if scorer is None:
        return knn.withColumnRenamed("cosine", "score")
    return scorer(knn.drop("cosine").withColumnsRenamed({"src": "a", "dst": "b"})).withColumnsRenamed(
        {"a": "src", "b": "dst"}).select("src", "dst", "rank", "dist", "score")


def song_graph(scored: DataFrame, prune: float = PRUNE_BELOW, k: int = TOP_K) -> DataFrame:
    """Edges whose unrounded score reaches ``prune``; scores are stored with four digits."""
    return scored.filter((F.col("rank") <= k) & (F.col("score") >= prune)).withColumn("score", tidy(F.col("score"), 4))


def song_graph_stats(nodes: DataFrame, scored: DataFrame, prune: float = PRUNE_BELOW) -> DataFrame:
    keep = F.col("score") >= prune
    per_src = scored.groupBy(F.col("src").alias("id")).agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("cut"))
    kept, cut = F.coalesce("kept", F.lit(0)), F.coalesce("cut", F.lit(0))
    return nodes.select("id").join(per_src, "id", "left").agg(
        F.count("*").alias("nodes"), F.sum(kept).alias("edges"), F.sum(cut).alias("pruned"),
        F.avg(kept).alias("avg_degree"), F.count_if(kept == 0).alias("isolated"))


def mood_path_costs(edges: DataFrame, profiles: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Least cost to every node within ``hops`` edges: ``(request_id, node, cost)``."""
    links, moods = store(_links(edges), "links"), store(profiles.select(F.col("id").alias("node"), "scores"), "path-moods")
    starts = store(starts.select("request_id", "start", "target"), "path-starts")
    if held_paths.can_hold(links, moods, starts):
        return _typed(held_paths.costs(links, moods, starts, MOOD_WEIGHT, hops), starts, "node")
    goals = starts.select("request_id", "target")
    state = starts.select("request_id", F.col("start").alias("node"), F.lit(0.0).alias("cost"))
    for _ in range(hops):
        reached = state.join(links, "node").groupBy("request_id", F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("base"))
        state = store(state.unionByName(_priced(reached, moods, goals).select("request_id", "node", "cost")).groupBy("request_id", "node").agg(
            F.min("cost").alias("cost")), "path-costs")
    return state


def _typed(found: DataFrame, starts: DataFrame, node: str) -> DataFrame:
    """Ids in the types of the request."""
    kinds = {c: starts.schema[c].dataType.simpleString() for c in ("request_id", "start")}
    return found.withColumns({"request_id": F.col("request_id").cast(kinds["request_id"]),
                              node: F.col(node).cast(kinds["start"] if node == "node" else f"array<{kinds['start']}>")})


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node"), "dst", (F.lit(1.0) - F.least("score", F.lit(1.0))).alias("step"))


def _priced(reached: DataFrame, moods: DataFrame, goals: DataFrame) -> DataFrame:
    """``cost``: the ``base`` cost of an arrival and the distance of its moods to the target; songs without moods are left out.

    The distance depends on where one arrives only, so it is added once per arrival and not once per edge.
    """
    return reached.join(moods, "node").join(goals, "request_id").withColumn(
        "cost", F.col("base") + F.lit(MOOD_WEIGHT) * l2_distance(F.col("scores"), F.col("target"))).drop("base", "scores", "target")


def mood_path(edges: DataFrame, profiles: DataFrame, starts: DataFrame, max_steps: int = MAX_STEPS,
              fallback: str = "closest", bucket: float = BUCKET) -> DataFrame:
    """Cheapest path from each start toward its target mood: ``(request_id, cost, path)``.

    Edge cost is (1 - score) + 0.4 * distance of the next song's moods to the target. A label is a request's least cost to a song,
    with the number of songs and the song before: no path is kept in it. Per round each request expands its open labels within
    ``bucket`` of its cheapest open one, and none that cost as much as its cheapest path of ``max_steps`` songs, so a request
    labels only what is nearer than its answer; where a full path exists it stops there. Equal costs go to fewer
    songs, then to the smaller song before. The answer is the cheapest path of ``max_steps`` songs. Where none exists, ``closest``
    takes the path that ends nearest the target and ``reference`` the last entry a priority queue would hand out. Paths are read
    back from the songs before. A graph that a task can hold is searched there (``held_paths``), to the same labels: the requests of a target
    together where no path can have ``max_steps`` songs, the others one by one. Labels of larger graphs are joined with the links.
    """
    links = store(_links(edges), "links")
    moods = store(profiles.select(F.col("id").alias("node"), "scores"), "path-moods")
    starts = store(starts.select("request_id", "start", "target"), "path-starts")
    if fallback != "reference" and held_paths.can_hold(links, moods, starts):
        return _typed(held_paths.paths(links, moods, starts, MOOD_WEIGHT, max_steps, bucket), starts, "path")
    goals = store(starts.select("request_id", "target"), "goals")
    id_type = starts.schema["start"].dataType.simpleString()
    state = store(starts.select("request_id", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(1).alias("songs"),
                                F.lit(None).cast(id_type).alias("before"), F.lit(True).alias("open")), "labels")
    while True:
        can = F.col("open") & (F.col("songs") < max_steps)
        bounds = state.groupBy("request_id").agg(
            F.min(F.when(can, F.col("cost"))).alias("first"), F.min(F.when(F.col("songs") >= max_steps, F.col("cost"))).alias("full"))
        going = bounds.filter(F.col("first").isNotNull() & (F.col("full").isNull() | (F.col("first") < F.col("full"))))
        going = store(going.select("request_id", F.least(F.col("first") + bucket, F.coalesce("full", F.lit(float("inf")))).alias("upto"), "first"), "open-requests")
        if going.isEmpty():
            break
        chosen = state.join(going, "request_id", "left").withColumn("now", F.coalesce(can & ((F.col("cost") < F.col("upto")) | (F.col("cost") == F.col("first"))), F.lit(False)))
        arrival = F.min(F.struct((F.col("cost") + F.col("step")).alias("base"), (F.col("songs") + 1).alias("songs"), F.col("node").alias("before")))
        reached = chosen.filter("now").join(links, "node").groupBy("request_id", F.col("dst").alias("node")).agg(arrival.alias("a")).select(
            "request_id", "node", "a.base", "a.songs", "a.before")
        kept = chosen.withColumn("open", F.col("open") & ~F.col("now")).drop("now", "upto", "first")
        both = kept.unionByName(_priced(reached, moods, goals).withColumn("open", F.lit(True)))
        # The start has no song before and keeps its label; an equal arrival does not open a song again.
        state = store(both.groupBy("request_id", "node").agg(F.min(F.struct("cost", "songs", "before", "open")).alias("m")).select(
            "request_id", "node", "m.cost", "m.songs", "m.before", "m.open"), "labels")
    full = state.filter(F.col("songs") >= max_steps).groupBy("request_id").agg(F.min(F.struct("cost", "songs", "node")).alias("full"))
    if fallback == "reference":
        ends = _last_popped(state, links, moods, goals)
    else:
        placed = state.join(moods, "node", "left").join(goals, "request_id")
        away = l2_distance(F.coalesce("scores", F.transform("target", lambda _: F.lit(0.0))), F.col("target"))
        ends = placed.groupBy("request_id").agg(F.min(F.struct(F.round(away, 9).alias("away"), "cost", "songs", "node")).alias("m")).select(
            "request_id", F.struct("m.cost", "m.songs", "m.node").alias("last"), F.lit(None).cast(id_type).alias("beyond"))
    found = starts.select("request_id").join(full, "request_id", "left").join(ends, "request_id", "left")
    end = F.coalesce("full", "last")
    beyond = F.when(F.col("full").isNull(), F.col("beyond"))
    return _read_back(found.select("request_id", end["cost"].alias("cost"), end["node"].alias("at"), F.array_compact(F.array(end["node"], beyond)).alias("path")), state)


def _read_back(ends: DataFrame, state: DataFrame) -> DataFrame:
    """Whole paths of ``ends (request_id, cost, at, path)``, by going from each song to the one before."""
    before = state.filter(F.col("before").isNotNull()).select("request_id", F.col("node").alias("at"), "before")
    walk = store(ends, "path-ends")
    while not walk.filter(F.col("at").isNotNull()).isEmpty():
        walk = store(walk.join(before, ["request_id", "at"], "left").select(
            "request_id", "cost", F.col("before").alias("at"),
            F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat(F.array("before"), "path")).alias("path")), "path-ends")
    return walk.select("request_id", "cost", "path")


def _last_popped(state: DataFrame, links: DataFrame, moods: DataFrame, goals: DataFrame) -> DataFrame:
    """Largest ``(cost, node, node before)`` pushed over an edge u->v with cost(u) < cost(v), else the start."""
    far = _priced(state.select("request_id", "node", F.col("cost").alias("far"), F.lit(0.0).alias("base")), moods, goals).select(
        "request_id", F.col("node").alias("dst"), "far", F.col("cost").alias("toll"))
    pushed = (
        state.join(links, "node").join(far, ["request_id", "dst"]).filter(F.col("cost") < F.col("far"))
        .groupBy("request_id").agg(F.max(F.struct((F.col("cost") + F.col("step") + F.col("toll")).alias("cost"), F.col("dst").alias("node"),
                                                  F.col("node").alias("before"), (F.col("songs") + 1).alias("songs"))).alias("p")))
    alone = state.filter(F.col("before").isNull()).select("request_id", F.col("node").alias("start"))
    return alone.join(pushed, "request_id", "left").select(
        "request_id", F.struct(F.coalesce("p.cost", F.lit(0.0)).alias("cost"), F.coalesce("p.songs", F.lit(1)).alias("songs"),
                               F.coalesce("p.before", "start").alias("node")).alias("last"), F.col("p.node").alias("beyond"))
