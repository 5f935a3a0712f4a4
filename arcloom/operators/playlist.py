"""Mood-arc playlists for many requests at once.

State is one row per request; candidates live in bounded arrays inside that row (at most 30 graph,
60 near and 60 pool songs). A step joins the state with the packed neighbour table, joins the few
pool draws that are needed, as thin rows, and decides inside the row.

Moods are positions in label order. The ``service`` profile is the web variant of the walk, ``batch``
the command-line one; they differ in tier sizes, flattening and length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.hashing import gumbel, hash_hex, uniform
from arcloom.functions.vectors import as_doubles, cosine_score, tidy
from arcloom.operators.moods import LOOSE_FLOOR, language_fits, mood_score
from arcloom.operators.positions import hash_positions
from arcloom.operators.search import top_moods
from arcloom.sources.workspace import store, store_by_key

# Tier sizes, bridge bound and blend weights.
GRAPH_K, NEAR_K, POOL_K = 30, 60, 60
ENOUGH = 3
BRIDGE_FLOOR = 0.4
ALPHA_START, ALPHA_SPAN = 0.4, 0.3
# Pools up to this size are spread over salts.
SMALL_POOL, SALTS = 4096, 32
# A song with more open requests than this, and than this share of all, gets its neighbours by broadcast.
BUSY_ROWS, BUSY_SONGS = 4096, 64
NEAREST_KEPT = 3 * NEAR_K - 1
DIGITS = 6


@dataclass(frozen=True)
class Profile:
    """Where the two variants of the walk differ."""

    name: str
    near_fetch: int        # neighbours looked at, the song itself included
    pool_draw: int         # songs drawn from a mood pool
    sort_by_mood: bool     # rank tiers by mood score, or keep distance order
    graph_cut_first: bool  # cut the graph tier before the mood filter
    bridge_fetch: int      # 0: bridges come from the graph only
    bridge_equal: bool     # the bridge bound itself counts
    stored_score: bool     # prefer the stored graph score
    extra_song: int        # songs beyond playlist_len


PROFILES = {
    "batch": Profile("batch", 3 * NEAR_K, 3 * POOL_K, True, False, 4 * GRAPH_K, False, True, 0),
    "service": Profile("service", NEAR_K + 10, POOL_K, False, True, 0, True, False, 1),
}


class Columns:
    """Column expressions of a step, built once and used again in every step of a walk."""

    def __init__(self):
        self._known: dict = {}

    def __call__(self, name: str, build):
        if name not in self._known:
            self._known[name] = build()
        return self._known[name]


# --- tables the walk reads ---------------------------------------------------------------------

def neighbour_table(scored: DataFrame, songs: DataFrame, k: int = 50, prune: float = 0.3,
                    digits: int = 4) -> DataFrame:
    """Songs with their packed neighbour list, nearest first, each with score, language and moods.

    ``scored`` is ``(src, dst, rank, dist, score)``. ``graph`` is the stored edge score or null.
    """
    edge = F.when((F.col("rank") <= k) & (F.col("score") >= prune), tidy(F.col("score"), digits))
    other = songs.select(F.col("id").alias("dst"), F.coalesce("language", F.lit("en")).alias("language"), "scores")
    entry = F.struct("rank", F.col("dst").alias("id"), edge.alias("graph"), F.col("score").alias("direct"),
                     "language", "scores")
    lists = scored.filter(F.col("rank") <= NEAREST_KEPT).join(other, "dst").groupBy(F.col("src").alias("current")).agg(
        F.array_sort(F.collect_list(entry)).alias("near"))
    return songs.select(F.col("id").alias("current"), as_doubles("embedding").alias("current_vec")).join(
        lists.hint("merge"), "current", "left")


def zone_plan(requests: DataFrame, profile: str = "batch") -> DataFrame:
    """``(request_id, zone, mood, zone_len, alpha)``; early zones take the remainder."""
    n = F.size("arc")
    total = F.col("playlist_len") - 1 + PROFILES[profile].extra_song
    base = F.floor(total / n).cast("int")
    return requests.filter(n > 0).select(
        "request_id", F.posexplode("arc").alias("zone", "mood"), n.alias("n"), base.alias("base"), (total - base * n).alias("over")
    ).select(
        "request_id", "zone", "mood", (F.col("base") + F.when(F.col("zone") < F.col("over"), 1).otherwise(0)).alias("zone_len"),
        (F.lit(ALPHA_START) + F.lit(ALPHA_SPAN) * F.col("zone") / F.greatest(F.col("n") - 1, F.lit(1))).alias("alpha"))


def validate_requests(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """``errors array<string>`` per request; empty means valid."""
    unknown = F.array_sort(F.array_except("arc", "_known"))
    errors = F.array(
        F.when(F.coalesce(F.size("arc"), F.lit(0)) <= 0, F.lit("empty arc")),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown moods: "), F.array_join(unknown, ","))),
        F.when(~F.col("temperature").between(0.05, 3.0), F.lit("temperature out of range")),
        F.when(~F.col("playlist_len").between(5, 50), F.lit("length out of range")))
    known = labels.agg(F.collect_set("label")).scalar()
    return requests.withColumn("_known", known).withColumn("errors", F.array_compact(errors)).drop("_known")


def arc_positions(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """Arc labels as positions in label order; requests with an unknown label are left out."""
    ordered = labels.agg(F.array_sort(F.collect_list(F.struct("label_id", "label"))).alias("l"))
    names = ordered.select(F.transform("l", lambda s: s["label"])).scalar()
    arc = F.transform("arc", lambda m: (F.array_position("_names", m) - 1).cast("int"))
    placed = requests.withColumn("_names", names).withColumn("arc", arc).drop("_names")
    return placed.filter((F.size("arc") > 0) & ~F.array_contains("arc", -1))


# --- candidate tiers, inside the row -------------------------------------------------------------

def _loose(mood: Column, wanted: Column):
    return lambda e: (mood_score(e["scores"], mood) > LOOSE_FLOOR) & language_fits(wanted, e["language"])


def _ranked(entries: Column, score, source: str, k: int, by_score: bool) -> Column:
    """Entries as candidates, the best ``k`` by mood score (or in the order given)."""
    cands = F.transform(entries, lambda e, i: F.struct(
        (-score(e) if by_score else i.cast("double")).alias("ord"), e["id"].alias("id"), score(e).alias("mood_score"),
        e["graph"].alias("graph"), e["direct"].alias("direct"), F.lit(source).alias("source")))
    return F.slice(F.array_sort(cands), 1, k)


def _graph_tier(near: Column, mood: Column, wanted: Column, p: Profile, k: int = GRAPH_K) -> Column:
    edges = F.filter(near, lambda e: e["graph"].isNotNull())
    if p.graph_cut_first:
        edges = F.slice(edges, 1, k)
    return _ranked(F.filter(edges, _loose(mood, wanted)), lambda e: mood_score(e["scores"], mood), "graph", k, p.sort_by_mood)


def _near_tier(near: Column, mood: Column, wanted: Column, p: Profile, k: int = NEAR_K) -> Column:
    fetched = F.filter(near, lambda e: (e["rank"] < p.near_fetch) & _loose(mood, wanted)(e))
    bare = F.transform(fetched, lambda e: e.withField("graph", F.lit(None).cast("double")))
    return _ranked(bare, lambda e: mood_score(e["scores"], mood), "near", k, p.sort_by_mood)


def _bridge_tier(near: Column, mood: Column, other: Column, p: Profile, k: int = GRAPH_K) -> Column:
    def both(e):
        a, b = mood_score(e["scores"], mood), mood_score(e["scores"], other)
        return ((a >= BRIDGE_FLOOR) & (b >= BRIDGE_FLOOR)) if p.bridge_equal else ((a > BRIDGE_FLOOR) & (b > BRIDGE_FLOOR))

    edges = F.filter(near, lambda e: e["graph"].isNotNull())
    if p.graph_cut_first:
        edges = F.slice(edges, 1, k)
    if p.bridge_fetch:
        bare = F.transform(F.filter(near, lambda e: e["rank"] < p.bridge_fetch),
                           lambda e: e.withField("graph", F.lit(None).cast("double")))
        edges = F.when(F.size(edges) > 0, edges).otherwise(bare)
    mean = lambda e: (mood_score(e["scores"], mood) + mood_score(e["scores"], other)) / 2
    return _ranked(F.filter(edges, both), mean, "bridge", k, p.sort_by_mood)


def _merge(first: Column, second: Column) -> Column:
    """First list, then the entries of the second whose id is new."""
    ids = F.transform(first, lambda e: e["id"])
    return F.concat(first, F.filter(second, lambda e: ~F.array_contains(ids, e["id"])))


def _unplayed(near: Column, played: Column) -> Column:
    return F.filter(near, lambda e: ~F.array_contains(played, e["id"]))


def _draw_positions(pool_n: Column, size: Column, seed, *keys) -> Column:
    """``size`` different positions of a pool; all of a small pool.

    The pool, turned by a random offset, is cut into ``size`` strata and one position is drawn from each:
    no repeats, the same chance for every song, and nothing is read but the drawn rows.
    """
    def start(j):
        return F.floor(j * pool_n / size)

    def one(j):
        inside = start(j) + F.floor(uniform(seed, *keys, j) * (start(j + 1) - start(j)))
        return F.pmod(inside + F.floor(uniform(f"{seed}-turn", *keys) * pool_n), pool_n)

    count = F.least(pool_n, size)
    drawn = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda j: F.when(
        pool_n <= size, j.cast("long")).otherwise(one(j)))
    return F.when(count > 0, drawn).otherwise(F.array().cast("array<bigint>"))


def _with_near(state: DataFrame, neighbours: DataFrame, cols: Columns | None = None, busy=()) -> DataFrame:
    """State rows with their unplayed neighbours; ``busy`` songs, a bounded number, are joined by broadcast."""
    near = (cols or Columns())("unplayed", lambda: F.coalesce(
        _unplayed(F.col("near"), F.col("played")), F.array().cast(neighbours.schema["near"].dataType)))
    if not busy:
        return state.join(neighbours, "current", "left").withColumn("near", near)
    at_busy = F.coalesce(F.col("current").isin(list(busy)), F.lit(False))
    spread = state.filter(at_busy).join(F.broadcast(neighbours.filter(at_busy)), "current", "left")
    return state.filter(~at_busy).join(neighbours, "current", "left").unionByName(spread).withColumn("near", near)


def _busy_songs(state: DataFrame, n_rows: int) -> list:
    """The songs at which very many requests are, ``BUSY_SONGS`` at most."""
    if n_rows <= BUSY_ROWS:
        return []
    counts = state.filter(F.col("current").isNotNull()).groupBy("current").agg(F.count("*").alias("n"))
    return [r["current"] for r in counts.filter(F.col("n") > max(BUSY_ROWS, n_rows // BUSY_SONGS)).collect()]


POOL_KEYS = ["mood", "other", "pos", "salt"]


def _salt() -> Column:
    return F.pmod(F.xxhash64("request_id"), F.lit(SALTS)).cast("int")


def salted_pools(pools: DataFrame) -> DataFrame:
    """Pools with a ``salt``: every request may draw from the same small pool, so its rows are repeated."""
    copies = F.when(F.col("pos_n") <= SMALL_POOL, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return pools.withColumn("salt", F.explode(copies))


def _with_pool_draws(state: DataFrame, pools: DataFrame, sizes: DataFrame, needs_pool: Column, needs_shared: Column,
                     p: Profile, seed, cols: Columns | None = None, scorer=None) -> DataFrame:
    """State rows plus ``pool`` and ``shared``: candidates drawn for the rows that need them.

    ``scorer`` takes the two vector columns, which then hold song states; without one the direct score is the cosine.
    """
    one = sizes.filter("other = -1").select("mood", F.col("pool_n").alias("n_one"))
    two = sizes.filter("other <> -1").select("mood", F.col("other").alias("next_mood"), F.col("pool_n").alias("n_two"))
    sized = state.join(one, "mood", "left").join(two, ["mood", "next_mood"], "left")
    turn = F.col("zone") if "zone" in state.columns else F.lit(0)
    keys = ["request_id", turn, F.size("played")]

    def plan(kind, n, size, other):
        want = F.lit(size) + F.size("played")
        spots = _draw_positions(F.coalesce(n, F.lit(0)), want, f"{seed}-{kind}", *keys)
        salt = F.when(n <= SMALL_POOL, _salt()).otherwise(0)
        return F.transform(spots, lambda s: F.struct(
            F.lit(kind).alias("kind"), other.alias("other"), s.alias("pos"), salt.alias("salt")))

    def all_draws():
        none = F.array().cast("array<struct<kind:string,other:int,pos:bigint,salt:int>>")
        return F.concat(
            F.when(needs_pool, plan("pool", F.col("n_one"), p.pool_draw, F.lit(-1))).otherwise(none),
            F.when(needs_shared, plan("shared", F.col("n_two"), 2 * GRAPH_K, F.col("next_mood"))).otherwise(none))

    def lists():
        entry = F.struct(
            hash_hex(f"{seed}-cut", "request_id", "_id").alias("h"), F.col("_id").alias("id"),
            F.lit(None).cast("double").alias("graph"), (F.col("_direct") if scorer else cosine_score(F.col("current_vec"), F.col("_vec"))).alias("direct"),
            F.col("_language").alias("language"), F.col("_scores").alias("scores"))
        return [F.array_sort(F.collect_list(F.when(F.col("_fits") & (F.col("_kind") == kind), entry))).alias(name)
                for kind, name in (("pool", "_p"), ("shared", "_q"))]

    cols = cols or Columns()
    rest = [c for c in state.columns if c != "request_id"]

    def thin_rows():
        """The whole state once, without a position, and next to it one small row per draw."""
        whole = F.struct(*rest)
        own = F.struct(F.lit("state").alias("kind"), F.lit(-2).alias("other"), F.xxhash64("request_id").alias("pos"), F.lit(0).alias("salt"), whole.alias("whole"))
        draws = F.transform(all_draws(), lambda d: F.struct(
            d["kind"].alias("kind"), d["other"].alias("other"), d["pos"].alias("pos"), d["salt"].alias("salt"),
            F.when(F.lit(False), whole).alias("whole")))
        return F.concat(F.array(own), draws)

    spread = sized.select("request_id", "mood", "current_vec", "played", F.explode(cols("draws", thin_rows)).alias("_d")).select(
        "request_id", "mood", F.when(F.col("_d.kind") != "state", F.col("current_vec")).alias("current_vec"),
        F.when(F.col("_d.kind") != "state", F.col("played")).alias("played"), F.col("_d.kind").alias("_kind"),
        F.col("_d.other").alias("other"), F.col("_d.pos").alias("pos"), F.col("_d.salt").alias("salt"), F.col("_d.whole").alias("_whole"))
    drawn = pools.select(
        *POOL_KEYS, F.col("id").alias("_id"),
        F.coalesce("language", F.lit("en")).alias("_language"), F.col("scores").alias("_scores"),
        as_doubles("embedding").alias("_vec"))
    met = spread.join(drawn, POOL_KEYS, "left").withColumn("_fits", F.col("_id").isNotNull() & ~F.array_contains("played", F.col("_id")))
    if scorer:
        met = met.withColumn("_direct", scorer(F.col("current_vec"), F.col("_vec")))
    return met.groupBy("request_id").agg(
        F.first("_whole", ignorenulls=True).alias("_s"), *cols("lists", lists)
    ).select("request_id", "_s.*", F.slice("_p", 1, p.pool_draw).alias("pool"), F.slice("_q", 1, 2 * GRAPH_K).alias("shared"))


def _pool_tier(pool: Column, mood: Column, wanted: Column, p: Profile, k: int = POOL_K) -> Column:
    fits = F.filter(pool, lambda e: language_fits(wanted, e["language"]))
    return _ranked(fits, lambda e: mood_score(e["scores"], mood), "pool", k, p.sort_by_mood)


def _shared_tier(shared: Column, mood: Column, other: Column, k: int = GRAPH_K) -> Column:
    a, b = (lambda e: mood_score(e["scores"], mood)), (lambda e: mood_score(e["scores"], other))
    fits = F.filter(shared, lambda e: (a(e) > BRIDGE_FLOOR) & (b(e) > BRIDGE_FLOOR))
    return _ranked(fits, lambda e: (a(e) + b(e)) / 2, "bridge", k, True)


def _spread(df: DataFrame, cands: Column) -> DataFrame:
    return df.select("request_id", F.posexplode(cands).alias("p", "c")).select(
        "request_id", (F.col("p") + 1).alias("nth"), "c.id", "c.source", "c.mood_score",
        F.col("c.graph").alias("graph_score"), F.col("c.direct").alias("direct"))


def candidates_graph(state: DataFrame, neighbours: DataFrame, profile: str = "batch") -> DataFrame:
    """Tier 1: unplayed graph neighbours that pass the loose rule."""
    return _spread(_with_near(state, neighbours),
                   _graph_tier(F.col("near"), F.col("mood"), F.col("wanted"), PROFILES[profile]))


def candidates_ann(state: DataFrame, neighbours: DataFrame, profile: str = "batch") -> DataFrame:
    """Tier 2: near songs that pass the loose rule."""
    return _spread(_with_near(state, neighbours),
                   _near_tier(F.col("near"), F.col("mood"), F.col("wanted"), PROFILES[profile]))


def candidates_global(state: DataFrame, spots: DataFrame, pools: DataFrame, sizes: DataFrame, seed="global",
                      profile: str = "batch") -> DataFrame:
    """Tier 3: a random draw from the pool of the wanted mood; ``spots`` has ``current`` and ``current_vec``."""
    p = PROFILES[profile]
    placed = state.join(spots.select("current", "current_vec"), "current", "left")
    drawn = _with_pool_draws(_with_next(placed), salted_pools(pools), sizes, F.lit(True), F.lit(False), p, seed)
    return _spread(drawn, _pool_tier(F.col("pool"), F.col("mood"), F.col("wanted"), p))


def _with_next(state: DataFrame) -> DataFrame:
    return state if "next_mood" in state.columns else state.withColumn("next_mood", F.lit(None).cast("int"))


def _with_candidates(state: DataFrame, neighbours: DataFrame, pools: DataFrame, sizes: DataFrame, bridge: Column,
                     p: Profile, seed, cols: Columns | None = None, scorer=None, busy=()) -> DataFrame:
    """State rows plus ``cands``, and ``bridged`` where they come from the bridge rule."""
    cols = cols or Columns()
    near, mood, wanted = F.col("near"), F.col("mood"), F.col("wanted")
    local = _with_near(_with_next(state), neighbours, cols, busy).withColumns({
        "_bridge": cols("bridge", lambda: F.when(bridge, _bridge_tier(near, mood, F.col("next_mood"), p))),
        "_graph": cols("graph", lambda: _graph_tier(near, mood, wanted, p)),
        "_near": cols("near", lambda: _near_tier(near, mood, wanted, p))})
    merged = cols("merged", lambda: F.when(F.size("_graph") >= ENOUGH, F.col("_graph")).otherwise(
        _merge(F.col("_graph"), F.col("_near"))))
    no_bridge = F.coalesce(F.size("_bridge"), F.lit(0)) <= 0
    local = local.withColumn("_local", merged).drop("near", "_graph", "_near").withColumn(
        "_bridge", F.when(~no_bridge, F.col("_bridge")))
    shared = bridge & F.col("_bridge").isNull() & F.lit(bool(p.bridge_fetch))
    drawn = _with_pool_draws(local, pools, sizes, (F.size("_local") < ENOUGH) & F.col("_bridge").isNull(), shared, p, seed, cols, scorer)
    late = cols("late", lambda: _shared_tier(F.col("shared"), mood, F.col("next_mood")))
    tiers = cols("tiers", lambda: F.when(F.size("_local") >= ENOUGH, F.col("_local")).otherwise(
        _merge(F.col("_local"), _pool_tier(F.col("pool"), mood, wanted, p))))
    return drawn.withColumn("_late", late).withColumn(
        "_b", F.coalesce("_bridge", F.when(F.size("_late") > 0, F.col("_late")))).withColumns({
        "cands": F.coalesce("_b", tiers), "bridged": F.col("_b").isNotNull(),
    }).drop("_b", "_late", "_bridge", "_local", "pool", "shared")


def candidates_tiered(state: DataFrame, neighbours: DataFrame, pools: DataFrame, sizes: DataFrame, seed="tier",
                      profile: str = "batch") -> DataFrame:
    """Graph tier; with fewer than three songs the near tier is added, then the pool tier."""
    rows = _with_candidates(state, neighbours, salted_pools(pools), sizes, F.lit(False), PROFILES[profile], seed)
    return _spread(rows, F.col("cands"))


def bridge_candidates(state: DataFrame, neighbours: DataFrame, pools: DataFrame, sizes: DataFrame, seed="bridge",
                      profile: str = "batch") -> DataFrame:
    """Songs strong in ``mood`` and ``next_mood``: from the graph, else near songs, else the shared pool."""
    rows = _with_candidates(state, neighbours, salted_pools(pools), sizes, F.lit(True), PROFILES[profile], seed)
    return _spread(rows.filter("bridged"), F.col("cands"))


def exclude_played(cands: DataFrame, played: DataFrame) -> DataFrame:
    return cands.join(played.select("request_id", "id"), ["request_id", "id"], "left_anti")


def merge_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists per request, an id taken from the first list where both have it."""
    tagged = first.withColumn("tier", F.lit(1)).unionByName(second.withColumn("tier", F.lit(2)))
    best = Window.partitionBy("request_id", "id").orderBy("tier")
    return tagged.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


# --- scoring and drawing -------------------------------------------------------------------------

def score_candidates(cands: DataFrame, profile: str = "batch", scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``transition``: the stored graph score where the profile prefers it, else the direct score.

    With a ``scorer`` of pairs ``(a, b)`` the direct score of ``cands (current, id, ...)`` is computed, for those candidates
    only whose stored score does not count.
    """
    stored = F.col("graph_score") if PROFILES[profile].stored_score else F.lit(None).cast("double")
    if scorer is None:
        return cands.withColumn("transition", F.coalesce(stored, F.col("direct")))
    known = cands.filter(stored.isNotNull()).withColumn("transition", stored)
    scored = scorer(cands.filter(stored.isNull()).withColumnsRenamed({"current": "a", "id": "b"})).withColumnsRenamed(
        {"a": "current", "b": "id", "score": "transition"})
    return known.unionByName(scored.select(*known.columns))


def blend(transition: Column, mood: Column, alpha: Column) -> Column:
    return (F.lit(1.0) - alpha) * transition + alpha * mood


def blend_scores(cands: DataFrame) -> DataFrame:
    """(1 - alpha) * transition + alpha * mood score."""
    return cands.withColumn("score", blend(F.col("transition"), F.col("mood_score"), F.col("alpha")))


def median_cap(cands: DataFrame, group="request_id") -> DataFrame:
    """Clip scores at 1.5 times the group's median where that is positive.

    Groups are candidate lists; the median is aggregated before the shuffle and joined back.
    """
    stats = cands.groupBy(group).agg(F.percentile("score", 0.5).alias("med"), F.count("*").alias("n"))
    cap = F.when((F.col("n") > 1) & (F.col("med") > 0), F.least("score", F.lit(1.5) * F.col("med"))).otherwise(F.col("score"))
    return cands.join(stats, group).withColumn("score", cap).drop("med", "n")


def sqrt_damp(cands: DataFrame, group="request_id") -> DataFrame:
    """Square roots of a group's scores where its best is more than twice its second best."""
    best = cands.groupBy(group).agg(F.max("score").alias("hi"), F.count("*").alias("n"))
    under = cands.join(best, group).groupBy(group).agg(
        F.first("hi").alias("hi"), F.first("n").alias("n"),
        F.count_if(F.col("score") == F.col("hi")).alias("at_top"),
        F.max(F.when(F.col("score") < F.col("hi"), F.col("score"))).alias("below"))
    second = F.when(F.col("at_top") > 1, F.col("hi")).otherwise(F.col("below"))
    damp = (F.col("n") > 1) & (F.col("hi") > 2 * second)
    return cands.join(under.select(group, damp.alias("damp")), group).withColumn(
        "score", F.when(F.col("damp"), F.sqrt(F.greatest("score", F.lit(0.0)))).otherwise(F.col("score"))).drop("damp")


def softmax_probs(cands: DataFrame, temperature: Column, group="request_id") -> DataFrame:
    """``prob`` within each group, by two small aggregates instead of one window per group."""
    logits = cands.withColumn("_l", F.col("score") / temperature)
    top = logits.groupBy(group).agg(F.max("_l").alias("_top"))
    shifted = logits.join(top, group).withColumn("_e", F.exp(F.col("_l") - F.col("_top")))
    total = shifted.groupBy(group).agg(F.sum("_e").alias("_sum"))
    return shifted.join(total, group).withColumn("prob", F.col("_e") / F.col("_sum")).drop("_l", "_top", "_e", "_sum")


def softmax_sample(cands: DataFrame, temperature: Column, seed, group="request_id") -> DataFrame:
    """One row per group with probability proportional to exp(score / temperature)."""
    u = uniform(seed, group, "id")
    key = F.struct(tidy(F.col("score") / temperature + gumbel(u), 9).alias("key"), "id", "score")
    return cands.groupBy(group).agg(F.max(key).alias("m")).select(group, "m.id", "m.score")


def _with_draw(rows: DataFrame, profile: Profile, alpha: Column, seed, *keys, cols: Columns | None = None) -> DataFrame:
    """Score, flatten and draw one of ``cands`` into ``drawn``; null where there is none.

    What a lambda needs from the whole array is its own column, so it is computed once per row.
    """
    def transition(c):
        return F.coalesce(c["graph"], c["direct"]) if profile.stored_score else c["direct"]

    cols = cols or Columns()
    scored = cols("scored", lambda: F.transform("cands", lambda c: F.struct(
        blend(transition(c), c["mood_score"], alpha).alias("score"), c["id"].alias("id"), c["source"].alias("source"),
        uniform(seed, *keys, c["id"]).alias("u"))))
    rows = rows.withColumn("_scored", scored).withColumn(
        "_sorted", F.array_sort(F.transform("_scored", lambda c: c["score"])))
    n = F.size("_sorted")

    def nth(i):
        return F.try_element_at("_sorted", F.greatest(F.floor(i).cast("int"), F.lit(1)))

    if profile.stored_score:
        rows = rows.withColumn("_cap", F.lit(1.5) * (nth((n + 1) / 2) + nth((n + 2) / 2)) / 2)
        flat = lambda s: F.when((F.col("_cap") > 0) & (s > F.col("_cap")), F.col("_cap")).otherwise(s)
        heat = F.col("temperature") + F.lit(1e-8)
    else:
        rows = rows.withColumn("_damp", (n > 1) & (nth(n) > 2 * nth(n - 1)))
        flat = lambda s: F.when(F.col("_damp"), F.sqrt(F.greatest(s, F.lit(0.0)))).otherwise(s)
        heat = F.greatest("temperature", F.lit(1e-6))
    keyed = cols("keyed", lambda: F.transform("_scored", lambda c: F.struct(
        tidy(flat(c["score"]) / heat + gumbel(c["u"]), 9).alias("key"), c["id"].alias("id"), c["score"].alias("score"),
        c["source"].alias("source"))))
    return rows.withColumn("drawn", F.array_max(keyed)).drop("_scored", "_sorted", "_cap", "_damp")


# --- seeds and the walk --------------------------------------------------------------------------

def seed_random(requests: DataFrame, pools: DataFrame, sizes: DataFrame, songs: DataFrame, seed="seed") -> DataFrame:
    """``(request_id, id)``: a random song of the first mood's pool; with a language, one of that language
    if the pool has any. An empty pool gives the first song.

    Pools are numbered per mood and language and per mood, so a draw is one equi-join whatever the pool's size.
    """
    one = pools.filter("other = -1").select("mood", "id", F.coalesce("language", F.lit("en")).alias("lang"))
    by_language = hash_positions(one, f"{seed}-order", ["id"], groups=["mood", "lang"])
    by_mood = hash_positions(one.withColumn("lang", F.lit("")), f"{seed}-order", ["id"], groups=["mood", "lang"])
    numbered = store(by_language.unionByName(by_mood), "numbered-pools")
    counts = numbered.groupBy("mood", "lang").agg(F.first("pos_n").alias("n"))
    first = requests.withColumns({"mood": F.element_at("arc", 1), "lang": F.coalesce("wanted", F.lit(""))})
    spoken = first.join(counts, ["mood", "lang"], "left").select("request_id", "mood", F.when(F.col("n") > 0, F.col("lang")).otherwise("").alias("lang"))
    spot = F.least(F.floor(uniform(f"{seed}-pick", "request_id") * F.col("n")), F.col("n") - 1)
    chosen = spoken.join(counts, ["mood", "lang"]).withColumn("pos", spot).join(
        numbered.select("mood", "lang", "pos", "id"), ["mood", "lang", "pos"]).select("request_id", "id")
    lowest = songs.agg(F.min("id")).scalar()
    return requests.select("request_id").join(chosen, "request_id", "left").select(
        "request_id", F.coalesce("id", lowest).alias("id"))


def walk_start(requests: DataFrame, seeds: DataFrame, p: Profile) -> DataFrame:
    """State of every request at its seed song ``(request_id, id)``, before the first step."""
    n = F.size("arc")
    total = F.col("playlist_len") - 1 + p.extra_song
    base = F.floor(total / n).cast("int")
    lens = F.transform("arc", lambda _, z: base + F.when(z < total - base * n, 1).otherwise(0))
    id_type = seeds.schema["id"].dataType.simpleString()
    return requests.join(seeds.withColumnRenamed("id", "current"), "request_id").select(
        "request_id", "current", "arc", lens.alias("lens"), "temperature", "wanted", F.array("current").alias("played"),
        F.lit(0).alias("zone"), F.lit(0).alias("filled"),
        F.array().cast(f"array<struct<id:{id_type},mood:int,score:double,source:string,bridge:boolean>>").alias("picks"))


def _next_zone() -> Column:
    """First zone with room left, from the current one on; null when the walk is over."""
    open_zone = lambda z: F.when(z == F.col("zone"), F.col("filled") < F.element_at("lens", z + 1)).otherwise(
        F.element_at("lens", z + 1) > 0)
    last = F.size("arc") - 1
    rest = F.when(F.col("zone") <= last, F.sequence(F.col("zone"), last)).otherwise(F.array().cast("array<int>"))
    return F.try_element_at(F.filter(rest, open_zone), F.lit(1))


def walk_step(state: DataFrame, neighbours: DataFrame, pools: DataFrame, sizes: DataFrame, p: Profile,
              seed, cols: Columns | None = None, scorer=None, busy=()) -> DataFrame:
    """Advance every request by one song, or to the next zone where nothing fits; ``pools`` are salted.

    The zone and the number of songs played key the random draws, so the plan's text and its generated
    code are the same in every step.
    """
    cols = cols or Columns()
    open_rows = state.withColumn("_z", cols("zone", _next_zone)).filter("_z is not null").withColumns({
        "filled": F.when(F.col("_z") == F.col("zone"), F.col("filled")).otherwise(0), "zone": F.col("_z")}).drop("_z")
    placed = open_rows.withColumns({
        "mood": F.element_at("arc", F.col("zone") + 1),
        "next_mood": F.try_element_at(F.col("arc"), (F.col("zone") + 2).cast("int"))})
    bridge = F.col("next_mood").isNotNull() & (F.col("filled") == F.element_at("lens", F.col("zone") + 1) - 1)
    rows = _with_candidates(placed, neighbours, pools, sizes, bridge, p, seed, cols, scorer, busy)
    alpha = F.lit(ALPHA_START) + F.lit(ALPHA_SPAN) * F.col("zone") / F.greatest(F.size("arc") - 1, F.lit(1))
    drawn = _with_draw(rows, p, alpha, f"{seed}-draw", "request_id", "zone", F.size("played"), cols=cols)
    got = F.col("drawn").isNotNull()
    pick = F.array(F.struct(F.col("drawn.id").alias("id"), F.col("mood").alias("mood"), F.col("drawn.score").alias("score"),
                            F.col("drawn.source").alias("source"), F.col("bridged").alias("bridge")))
    return drawn.select(
        "request_id", F.when(got, F.col("drawn.id")).otherwise(F.col("current")).alias("current"), "arc", "lens",
        "temperature", "wanted", F.when(got, F.concat("played", F.array("drawn.id"))).otherwise(F.col("played")).alias("played"),
        F.when(got, F.col("zone")).otherwise(F.col("zone") + 1).alias("zone"),
        F.when(got, F.col("filled") + 1).otherwise(0).alias("filled"),
        F.when(got, F.concat("picks", pick)).otherwise(F.col("picks")).alias("picks"))


def generate_playlists(requests: DataFrame, seeds: DataFrame, neighbours: DataFrame, pools: DataFrame,
                       sizes: DataFrame, profile: str = "batch", seed="walk", scorer=None) -> DataFrame:
    """``(request_id, pos, id, mood, score, source, bridge)``; position 0 is the seed.

    Direct scores are cosines. For those of the classifier, ``neighbours`` come from lists that it has scored, their vectors and those of
    ``pools`` are song states, and ``scorer`` is a ``scoring.state_scorer`` for the songs that are drawn on the way; the
    ``service`` profile then never uses a stored score.

    ``requests`` holds ``request_id, arc (positions), temperature, playlist_len, wanted``. State, neighbours and pools are
    stored tables. The neighbour lists, by far the largest, are written in buckets of their song once, so that a step moves only the
    state; the lists of songs with very many requests are broadcast.
    """
    p = PROFILES[profile]
    state = store(walk_start(requests, seeds, p), "walk-start")
    near, table = store_by_key(neighbours, "neighbours", "current")
    pools = store(salted_pools(pools), "pools")
    sizes = store(sizes, "pool-sizes")
    cols, done = Columns(), []
    while True:
        going = cols("zone", _next_zone).isNotNull()
        n_over, n_open = state.agg(F.count_if(~going), F.count_if(going)).first()
        if n_over or not done:
            done.append(state.filter(~going))
        if not n_open:
            break
        state = state.filter(going)
        busy = _busy_songs(state, n_open)
        state = store(walk_step(state, near, pools, sizes, p, seed, cols, scorer, busy), "walk-step")
    neighbours.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    finished = done[0]
    for part in done[1:]:
        finished = finished.unionByName(part)
    start = F.struct(F.element_at("played", 1).alias("id"), F.lit(None).cast("int").alias("mood"),
                     F.lit(None).cast("double").alias("score"), F.lit("seed").alias("source"), F.lit(False).alias("bridge"))
    return finished.select("request_id", F.posexplode(F.concat(F.array(start), "picks")).alias("pos", "s")).select(
        "request_id", "pos", "s.*")


def playlist_report(playlists: DataFrame, requests: DataFrame, profiles: DataFrame, n_moods: int = 2) -> DataFrame:
    """Playlist rows with their best moods, the playlist's size and whether it came out short."""
    sizes = requests.select("request_id", "playlist_len").join(
        playlists.groupBy("request_id").agg(F.count("*").alias("n_songs")), "request_id", "left")
    moods = top_moods(profiles, n_moods).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "label_id"))), lambda m: m["label_id"].cast("string")), ",").alias("moods"))
    return playlists.join(sizes, "request_id").join(moods, "id", "left").select(
        "request_id", "pos", "id", "moods", "score", "n_songs", (F.col("n_songs") < F.col("playlist_len")).alias("short"))


def arc_coverage(playlists: DataFrame, requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(request_id, zone, mood, n)``: playlist songs whose top mood is the arc's mood."""
    top = top_moods(profiles, 1).select("id", F.col("label_id").alias("mood"))
    counts = playlists.select("request_id", "id").join(top, "id").groupBy("request_id", "mood").agg(F.count("*").alias("n"))
    arcs = requests.select("request_id", F.posexplode("arc").alias("zone", "mood"))
    return arcs.join(counts, ["request_id", "mood"], "left").select(
        "request_id", "zone", "mood", F.coalesce("n", F.lit(0)).alias("n"))
