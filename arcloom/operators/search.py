"""Substring search of many terms in many songs, and seed resolution."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.moods import ranked_moods
from arcloom.sources.tables import overwrite_table
from arcloom.sources.workspace import store

GRAM = 3
MASK_BITS = 128
MASKS = [f"mask{i}" for i in range(MASK_BITS // 64)]


def _grams(text, size: int):
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    some = F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def _mask(grams: Column) -> list[Column]:
    """``MASK_BITS`` bits of which each gram sets one, as longs."""
    one, bit = F.lit(1).cast("long"), lambda g: F.pmod(F.xxhash64(g), F.lit(MASK_BITS))
    return [
        F.aggregate(grams, F.lit(0).cast("long"), lambda m, g: F.when(
            F.floor(bit(g) / 64) == word, m.bitwiseOR(F.call_function("shiftleft", one, F.pmod(bit(g), F.lit(64)).cast("int")))).otherwise(m))
        for word in range(MASK_BITS // 64)]


@dataclass(frozen=True)
class SearchIndex:
    """``places (id, text, text_id, in_name, in_artist)``, ``postings (bucket, gram, text_id, masks)``, ``counts (gram, n_texts)``."""

    places: DataFrame
    postings: DataFrame
    counts: DataFrame


def search_index(songs: DataFrame, buckets: int = 64) -> SearchIndex:
    """Write the index of the names and artists of ``songs``; it may be searched any number of times.

    A posting list is the distinct texts of a gram, by 64-bit hash, in the folder of its gram's bucket. Each entry has a mask of all grams of its
    text, so that most texts without the other grams of a term are left out inside the list. Texts stay with the songs: texts of equal hash
    only meet before the text itself is compared. Null and empty texts have no entry.
    """
    low = songs.select("id", F.lower("name").alias("name"), F.lower("artist").alias("artist"))
    same = F.coalesce(F.col("name") == F.col("artist"), F.lit(False))
    sides = F.array(F.struct(F.col("name").alias("text"), F.lit(True).alias("in_name"), same.alias("in_artist")),
                    F.struct(F.when(~same, F.col("artist")).alias("text"), F.lit(False).alias("in_name"), F.lit(True).alias("in_artist")))
    places = low.select("id", F.inline(sides)).filter(F.length("text") > 0).withColumn("text_id", F.xxhash64("text"))
    places = store(places, "search-places")
    every = F.flatten(F.array(*[_grams(F.col("text"), size) for size in range(1, GRAM + 1)]))
    texts = places.select("text_id", "text").distinct()
    masked = texts.select("text_id", every.alias("grams"), *[m.alias(name) for m, name in zip(_mask(_grams(F.col("text"), GRAM)), MASKS)])
    rows = masked.select(F.explode("grams").alias("gram"), "text_id", *MASKS).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    postings = overwrite_table(rows.hint("rebalance", "bucket"), "search-postings", ["bucket"])
    return SearchIndex(places, postings, store(postings.groupBy("gram").agg(F.count("*").alias("n_texts")), "search-counts"))


def _scanned(songs: DataFrame, terms: DataFrame) -> DataFrame:
    """Matches without an index: distinct texts meet the terms on the rarest n-gram of each term, out of the
    n-grams that some term needs; a hit is verified and then joined back to the songs by its text."""
    wanted = terms.select("term").filter(F.length("term") > 0).distinct()
    low = songs.select("id", F.lower("name").alias("name"), F.lower("artist").alias("artist"))
    texts = low.select(F.explode(F.array("name", "artist")).alias("text")).filter(F.length("text") > 0).distinct()
    own = F.when(F.length("term") == 1, _grams(F.col("term"), 1)).when(
        F.length("term") == 2, _grams(F.col("term"), 2)).otherwise(_grams(F.col("term"), GRAM))
    term_grams = wanted.select("term", F.explode(own).alias("gram"))
    every = F.flatten(F.array(*[_grams(F.col("text"), size) for size in range(1, GRAM + 1)]))
    text_grams = texts.select("text", F.explode(every).alias("gram")).join(term_grams.select("gram").distinct(), "gram", "left_semi")
    counts = text_grams.groupBy("gram").agg(F.count("*").alias("n_texts"))
    rarest = term_grams.join(counts, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("n_texts", F.lit(0)), "gram")).alias("r")).select("term", F.col("r.gram").alias("gram"))
    found = text_grams.join(rarest, "gram").filter(F.contains("text", "term")).select("term", "text")
    sides = [
        low.join(found, F.col(side) == F.col("text")).select(
            "term", "id", F.lit(side == "name").alias("in_name"), F.lit(side == "artist").alias("in_artist"))
        for side in ("name", "artist")]
    return sides[0].unionByName(sides[1]).groupBy("term", "id").agg(
        F.max("in_name").alias("in_name"), F.max("in_artist").alias("in_artist"))


def text_matches(songs: DataFrame | SearchIndex, terms: DataFrame) -> DataFrame:
    """``(term, id, in_name, in_artist)`` for every song whose name or artist contains the term.

    ``terms`` holds lower-case texts; null and empty ones match nothing. In a kept index, of each term's grams the rarest one's posting
    list is read, entries without the bits of its other grams are left out, and what remains is compared with the text itself. Plain songs
    are scanned for the grams of these terms alone, which is cheaper for a single search.
    """
    if not isinstance(songs, SearchIndex):
        return _scanned(songs, terms)
    index = songs
    wanted = terms.select("term").filter(F.length("term") > 0).distinct()
    own = F.when(F.length("term") == 1, _grams(F.col("term"), 1)).when(
        F.length("term") == 2, _grams(F.col("term"), 2)).otherwise(_grams(F.col("term"), GRAM))
    needs = [m.alias(f"need_{name}") for m, name in zip(_mask(_grams(F.col("term"), GRAM)), MASKS)]
    grams = wanted.select("term", *needs, F.explode(own).alias("gram")).join(index.counts, "gram", "left")
    rarest = grams.groupBy("term", *[f"need_{m}" for m in MASKS]).agg(
        F.min(F.struct(F.coalesce("n_texts", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    subset = reduce(lambda a, b: a & b, [F.col(m).bitwiseAND(F.col(f"need_{m}")) == F.col(f"need_{m}") for m in MASKS])
    likely = rarest.withColumn("gram", F.col("r.gram")).join(index.postings, "gram").filter(subset).select("term", "text_id").distinct()
    return likely.join(index.places, "text_id").filter(F.contains("text", "term")).groupBy("term", "id").agg(
        F.max("in_name").alias("in_name"), F.max("in_artist").alias("in_artist"))


def search_text(queries: DataFrame, songs: DataFrame, profiles: DataFrame, n: int = 10, index: SearchIndex | None = None) -> DataFrame:
    """The first ``n`` songs by id whose name or artist contains the query, with the top mood and the ``profile``, scores by mood.

    ``index`` is a kept index of ``songs``; without one they are scanned. A song without a profile has null for both.
    """
    terms = queries.select("query_id", F.lower("text").alias("term"))
    first = Window.partitionBy("term").orderBy("id")
    hits = (
        text_matches(index or songs, terms).select("term", "id").withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= n)
    )
    top = F.try_element_at(ranked_moods(F.col("scores")), F.lit(1))
    mood = profiles.select("id", F.element_at("mood_ids", top["pos"] + 1).alias("top_mood"), F.map_from_arrays("mood_ids", "scores").alias("profile"))
    return (
        terms.join(hits, "term").join(songs.select("id", "name", "artist"), "id").join(mood, "id", "left")
        .select("query_id", "rank", "id", "name", "artist", "top_mood", "profile")
    )


def resolve_seed(queries: DataFrame, songs: DataFrame, name_only: bool = False) -> DataFrame:
    """One song per query: name, then artist, then each word of two letters or more; lowest id first.

    Returns ``(query_id, id, stage, resolved)``; the song lists are reduced per term before any join.
    """
    text = F.lower("text")
    words = F.transform(F.split(text, r"\s+"), lambda w, i: F.struct(w.alias("term"), i.alias("word_pos")))
    whole = queries.select("query_id", text.alias("term"), F.lit(0).alias("word_pos"))
    stages = whole.withColumn("stage", F.lit(1))
    if not name_only:
        by_word = queries.select("query_id", F.explode(words).alias("w")).select(
            "query_id", "w.term", "w.word_pos").filter(F.length("term") >= 2).withColumn("stage", F.lit(3))
        stages = stages.unionByName(whole.withColumn("stage", F.lit(2))).unionByName(by_word)
    least = text_matches(songs, stages).groupBy("term").agg(
        F.min(F.when(F.col("in_name"), F.col("id"))).alias("by_name"),
        F.min(F.when(F.col("in_artist"), F.col("id"))).alias("by_artist"), F.min("id").alias("by_any"))
    hit = F.when(F.col("stage") == 1, F.col("by_name")).when(F.col("stage") == 2, F.col("by_artist")).otherwise(
        F.col("by_any"))
    first = (
        stages.join(least, "term").withColumn("id", hit).filter(F.col("id").isNotNull()).groupBy("query_id")
        .agg(F.min(F.struct("stage", "word_pos", "id")).alias("r"))
    )
    return queries.select("query_id").join(first, "query_id", "left").select(
        "query_id", F.col("r.id").alias("id"), F.col("r.stage").alias("stage"),
        F.col("r.id").isNotNull().alias("resolved"))


def resolve_seed_by_id(requests: DataFrame, songs: DataFrame) -> DataFrame:
    """Requests with ``resolved`` telling whether the seed song exists."""
    known = songs.select(F.col("id").alias("seed_id"), F.lit(True).alias("_known"))
    return requests.join(known, "seed_id", "left").withColumn(
        "resolved", F.coalesce("_known", F.lit(False))).drop("_known")


def top_moods(profiles: DataFrame, n: int = 2, key: str = "id") -> DataFrame:
    """The best ``n`` moods of each song; the first label wins ties. Works inside the row."""
    best = F.slice(ranked_moods(F.col("scores")), 1, n)
    return profiles.select(key, "mood_ids", F.posexplode(best).alias("r", "m")).select(
        key, (F.col("r") + 1).alias("rank"), F.element_at("mood_ids", F.col("m.pos") + 1).alias("label_id"),
        F.col("m.score").alias("score"))


