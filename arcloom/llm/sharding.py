"""Sharding by minimax contiguous partition, in DataFrame operations only.

Rows with equal texts are an atomic group; groups are ordered by the digest of their text, which spreads them evenly
over ``BINS`` bins for the running sums. The smallest capacity at which a greedy walk over the ordered sizes needs no more
than the given number of shards is searched; then the walk at that capacity gives the cuts. A search round
tests ``FAN`` capacities at once, and a step of the walk is one aggregate over the stored groups around the next
cuts: the largest running sum that the open shard still holds, for every tested capacity. The driver only holds those
few numbers.

Slots number the rows of a shard without gaps, in group order. A group of many rows is dealt by a hash of ``doc_id`` into parts of
about ``ROWS_PER_PART`` and numbered part after part, by ``doc_id`` inside a part, so a text that a third of the rows share is
not sorted in one task; rows of one text that share one id, null included, are one part.

Cases: null texts are empty. Shards may stay empty if there are fewer groups than shards. Rows with the same ``doc_id`` and
text get different slots of one shard. Texts of any length count whole; only their digests are moved. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.sources.workspace import store

SHARDS = 8
BINS_HEX = 3
FAN = 31
ROWS_PER_PART = 1000


def sized_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, digest)``: UTF-8 bytes plus 1, checksum and group of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.sha2(text, 256).alias("digest"))


def placed_groups(rows: DataFrame) -> DataFrame:
    """Groups in order with ``upto`` (bytes up to and with the group) and ``rows_before``, stored."""
    groups = store(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn(
        "bin", F.conv(F.substring("digest", 1, BINS_HEX), 16, 10).cast("int")), "groups")
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = groups.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).select(
        "bin", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bin_bytes"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bin_rows"))
    inside = Window.partitionBy("bin").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    return store(groups.join(F.broadcast(bins), "bin").select(
        "digest", "bytes", "n", (F.col("bin_bytes") + F.sum("bytes").over(inside)).alias("upto"),
        (F.col("bin_rows") + F.sum("n").over(inside) - F.col("n")).alias("rows_before")), "placed-groups")


def walk(groups: DataFrame, capacities: list[int], total: int, largest: int, shards: int) -> list[list[int]]:
    """Greedy cuts of each capacity: after every shard but the last, the bytes up to its end."""
    at = [0] * len(capacities)
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards - 1):
        reach = [a + c for a, c in zip(at, capacities)]
        near = groups.filter((F.col("upto") > min(reach) - largest) & (F.col("upto") <= max(reach)))
        found = near.agg(*[F.max(F.when(F.col("upto") <= r, F.col("upto"))).alias(f"c{i}") for i, r in enumerate(reach)]).first()
        at = [total if r >= total else f for r, f in zip(reach, found)]
        for c, a in zip(cuts, at):
            c.append(a)
    return cuts


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity for which the walk needs no more than ``shards``, and its cuts."""
    total, largest = groups.agg(F.max("upto"), F.max("bytes")).first()
    if total is None:
        return 0, [0] * (shards - 1)
    even = -(-total // shards)
    low, high = max(even, largest), even + largest
    while low < high:
        step = max(1, (high - low) // (FAN + 1))
        tested = sorted({min(high - 1, low + step * i) for i in range(FAN + 1)})
        for capacity, cuts in zip(tested, walk(groups, tested, total, largest, shards)):
            if total - sum(cuts[-1:]) <= capacity:
                high = capacity
                break
            low = capacity + 1
    return high, walk(groups, [high], total, largest, shards)[0]


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row of ``docs (doc_id, text)``."""
    rows = store(sized_rows(docs), "sized-rows")
    groups = placed_groups(rows)
    _, cuts = smallest_capacity(groups, shards)
    firsts = [0]
    if cuts:
        counted = groups.agg(*[F.coalesce(F.sum(F.when(F.col("upto") <= c, F.col("n"))), F.lit(0)).alias(f"r{i}") for i, c in enumerate(cuts)]).first()
        firsts += list(counted)
    shard = sum((F.when(F.col("upto") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    first = F.element_at(F.array(*[F.lit(int(f)) for f in firsts]), F.col("shard") + 1)
    homes = groups.select("digest", F.col("n").alias("group_rows"), shard.alias("shard"), "rows_before").withColumn(
        "group_slot", F.col("rows_before") - first)
    parts = F.ceil(F.col("group_rows") / ROWS_PER_PART)
    part = F.when(F.col("group_rows") > 1, F.pmod(F.xxhash64("doc_id"), parts)).otherwise(F.lit(0)).cast("long")
    placed = store(rows.join(homes, "digest").select(
        "doc_id", "size", "text_crc32", "digest", "shard", "group_slot", "group_rows", part.alias("part")), "rows-in-shards")
    single = placed.filter("group_rows = 1").select("doc_id", "size", "text_crc32", "shard", F.col("group_slot").alias("slot"))
    many = placed.filter("group_rows > 1")
    before = Window.partitionBy("digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = store(many.groupBy("digest", "part").agg(F.count("*").alias("n")), "part-counts")
    starts = store(counts.select("digest", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_slot")), "part-starts")
    inside = Window.partitionBy("digest", "part").orderBy("doc_id")
    numbered = many.join(starts, ["digest", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("group_slot") + F.col("part_slot") + F.row_number().over(inside) - 1).alias("slot"))
    return single.unionByName(numbered)
