"""Importance resampling towards a target distribution, with an exact cut-off by weighted medians of medians.

Features of a text are all runs of one and two of its words, each put into a bucket by the CRC-32 of its UTF-8 bytes. The
buckets are counted over all documents and over all target texts; the gain of a bucket is the floored logarithm, times 1000,
of its share in the target against its share in the documents, both with one added. A document's weight is the floored mean of
its gains; Gumbel noise from a hash of seed and id makes the highest scores a draw without replacement. A CRC is linear over bits, so
the one of a word is the exclusive or of one table value per byte, and that of a word pair follows from those of its two words;
all is done for a slice of texts at once.

The draw takes ``percent`` of the documents with enough words. The lowest key still drawn is found without a sort of all rows:
every partition gives the median of its remaining keys, the median of those, weighted by how many keys remain in each
partition, is a pivot with at least a quarter of all remaining keys on either side, and counting the keys above it discards
that share. A round reads the remaining keys only, so all rounds together read a multiple of the rows; the last few
(``FEW`` at most) are settled in the driver. Only the winners are sorted, by ranges, and numbered by the counts of the ranges before.

Keys are ``(score, doc_id, text hash)``, higher scores and smaller ids first, null ids before all. Equal rows are one key with a
number of copies, before the search, so no key is hot; the copies are expanded at the end.

Cases: null and empty texts, and texts without words, have no features and weight 0. Rows with equal ids and texts are drawn as
often as the cut-off allows, each with a rank of its own. Texts are read whole, whatever their length. An empty table gives
no rows; an empty target counts 0 everywhere. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.llm import kernels as K
from arcloom.sources.workspace import store

BUCKETS = 10_000
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
FEW = 256
#: Words of more bytes have their CRC taken one by one.
SHORT = 256
_SCORED = "doc_id {doc}, text_hash long, n_features long, weight long, score long"


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """``[d + 3, byte]``: what a byte does to the register ``d`` bytes later, from 3 bytes before its turn; and by length, the start value."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(0xEDB88320), first >> 1)
    rows = [np.arange(256, dtype=np.uint32) << np.uint32(s) for s in (16, 8, 0)]
    for _ in range(SHORT + 2):
        rows.append((rows[-1] >> np.uint32(8)) ^ first[rows[-1] & 255])
    starts = [np.uint32(0xFFFFFFFF)]
    for _ in range(SHORT + 1):
        starts.append((starts[-1] >> np.uint32(8)) ^ first[starts[-1] & 255])
    return np.array(rows), np.array(starts)


_TABLES, _STARTS = _crc_tables()


def feature_crcs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of the words of a slice, those of every word with the next one, and the first word of every text."""
    data = K.LOWER[data]
    starts, stops, first = K.words(data, off, K.ALPHANUMERIC)
    size = stops - starts
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), first
    brief = size <= SHORT
    length = np.where(brief, size, 0)
    begin = np.cumsum(length) - length
    step = np.arange(begin[-1] + length[-1]) - np.repeat(begin, length)
    byte = data[np.repeat(starts, length) + step]
    bits = _TABLES[np.repeat(length, length) - step + 2, byte]
    raw = np.zeros(n, np.uint32)
    if len(bits):
        raw[brief] = np.bitwise_xor.reduceat(bits, begin[brief])
    one = ~(raw ^ _STARTS[length])
    for i in np.flatnonzero(~brief).tolist():
        one[i] = zlib.crc32(data[starts[i] : stops[i]])
    # The register after a word and a blank, carried on over the next word, and what that word does itself.
    register, more = ~one[:-1], length[1:]
    register = (register >> np.uint32(8)) ^ _TABLES[3, (register ^ 0x20) & 255]
    two = ~(_carried(register, more) ^ raw[1:])
    for i in (np.flatnonzero(~brief[1:])).tolist():
        two[i] = zlib.crc32(data[starts[i + 1] : stops[i + 1]], zlib.crc32(b" ", int(one[i])))
    return one, two, first


def _carried(register: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Registers after ``length`` zero bytes."""
    out = np.zeros(len(register), np.uint32)
    for i in range(4):
        out ^= _TABLES[length + 2 - i, (register >> np.uint32(8 * i)) & 255]
    return out


def _features(data: np.ndarray, off: np.ndarray, buckets: int):
    one, two, first = feature_crcs(data, off)
    pairs = K.inside(first, 2, len(one))[:-1] if len(one) else np.zeros(0, bool)
    return (one % np.uint32(buckets)).astype(np.int64), (two % np.uint32(buckets)).astype(np.int64), pairs, first


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all of ``docs (text)``; only counters of a fixed number leave the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, off in K.slices(batch.column(0)):
                one, two, pairs, _ = _features(data, off, buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two[pairs], minlength=buckets)
        if total.any():
            yield K.sketch_parts(total, 4)

    counts = K.collect_sketch(docs.select("text").mapInArrow(count, K.SKETCH_SCHEMA), np.int64, np.add)
    return counts if len(counts) else np.zeros(buckets, np.int64)


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold logarithms of the ratio of shares, one per bucket."""
    s, t, n = int(docs.sum()), int(target.sum()), len(docs)
    each = zip(docs.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in each], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``(doc_id, text_hash, n_features, weight, score)`` of every row of ``docs (doc_id, text)``."""
    shared, buckets = K.ship(docs, gain), len(gain)
    sent = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _noise(seed).alias("noise"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for lo, hi, data, off in K.slices(batch.column(3)):
                one, two, pairs, first = _features(data, off, buckets)
                sums = np.zeros(len(one) + 1, np.int64)
                mine = gain[one]
                mine[:-1] += np.where(pairs, gain[two], 0)
                np.cumsum(mine, out=sums[1:])
                words = np.diff(first)
                n = np.maximum(2 * words - 1, 0)
                weight = np.where(n > 0, (sums[first[1:]] - sums[first[:-1]]) // np.maximum(n, 1), 0)
                rows = batch.slice(lo, hi - lo)
                noise = rows.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(n), pa.array(weight), pa.array(weight + noise)],
                    ["doc_id", "text_hash", "n_features", "weight", "score"])

    return sent.mapInArrow(score, _SCORED.format(doc=docs.schema["doc_id"].dataType.simpleString()))


def _noise(seed: int):
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


#: The columns of a key, each of them ascending.
KEY = ["low", "named", "id", "text_hash"]


def keyed(rows: DataFrame, score: str = "score", key: str = "doc_id") -> DataFrame:
    """``rows`` with their key as ascending columns."""
    return rows.withColumns({"low": -F.col(score), "named": F.col(key).isNotNull().cast("long"), "id": F.coalesce(F.col(key).cast("long"), F.lit(0))})


def _at_most(key: tuple):
    """Is the row's key at most this one?"""
    columns, out = list(zip(KEY, key)), None
    for name, value in reversed(columns):
        below, here = F.col(name) < value, F.col(name) == value
        out = (below | here) if out is None else below | (here & out)
    return out


def _exactly(key: tuple):
    return reduce(Column.__and__, [F.col(name) == value for name, value in zip(KEY, key)])


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted median key of the partition, with the number of its rows, copies included."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if parts:
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = np.lexsort(columns[3::-1])
        copies = np.cumsum(columns[4][order])
        at = order[np.searchsorted(copies, (copies[-1] + 1) // 2)]
        yield pa.RecordBatch.from_arrays([*[pa.array([int(c[at])]) for c in columns[:4]], pa.array([int(copies[-1])])], [*KEY, "copies"])


def cutoff(rows: DataFrame, wanted: int) -> tuple[tuple, int] | None:
    """The last key of the ``wanted`` smallest ``rows (*KEY, copies)``, and how many of its copies belong to them.

    ``rows`` are a stored table; a round keeps the keys on the side where the cut-off lies, and the table is written anew
    once half of what it held is gone, so all rounds together read a bounded multiple of it.
    """
    left = rows.select(*KEY, "copies")
    written = remaining = left.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    if not 0 < wanted <= remaining:
        return None
    kind = ", ".join(f"{c} long" for c in [*KEY, "copies"])
    while remaining > FEW:
        medians = sorted((tuple(r)[:4], r["copies"]) for r in left.mapInArrow(_medians, kind).collect())
        running, pivot = 0, None
        for pivot, copies in medians:
            running += copies
            if 2 * running >= remaining:
                break
        under, same = left.filter(_at_most(pivot)).agg(
            F.sum("copies"), F.sum(F.when(_exactly(pivot), F.col("copies")).otherwise(0))).first()
        if under - same < wanted <= under:
            return pivot, wanted - (under - same)
        if wanted <= under:
            left, remaining = left.filter(_at_most(pivot) & ~_exactly(pivot)), under - same
        else:
            left, remaining, wanted = left.filter(~_at_most(pivot)), remaining - under, wanted - under
        if 2 * remaining <= written:
            left, written = store(left, "remaining-keys"), remaining
    for r in sorted(left.collect()):
        if wanted <= r["copies"]:
            return tuple(r)[:4], wanted
        wanted -= r["copies"]
    return None


def _numbered(names: list[str]):
    """Copies before each row of the sorted partition, with the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            upto = before + np.cumsum(copies)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(upto - copies), pa.array(np.full(len(copies), part, np.int32))], [*names, "before", "part"])
            before = int(upto[-1]) if len(upto) else before

    return run


def ranked(winners: DataFrame) -> DataFrame:
    """``winners (*KEY, copies, ...)``, one row per copy, with ``rank`` from 1 in the order of the key."""
    tasks = int(winners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = winners.select("*", F.lit(0).cast("long").alias("before"), F.lit(0).alias("part")).schema
    dealt = winners.repartitionByRange(tasks, *KEY).sortWithinPartitions(*KEY).mapInArrow(_numbered(winners.columns), kind)
    dealt = store(dealt, "sorted-winners")
    parts = dealt.groupBy("part").agg(F.sum("copies").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    each = dealt.join(F.broadcast(starts), "part").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.withColumn("rank", F.col("start") + F.col("before") + F.col("copy")).drop("start", "before", "part", "copy", "copies")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for every row of ``docs (doc_id, text)``; ``rank`` is null where it is not drawn."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = scored(docs, gain, seed).groupBy("doc_id", "text_hash", "n_features", "weight", "score").agg(F.count("*").alias("copies"))
    rows = store(keyed(rows), "scored-documents")
    enough = F.col("n_features") >= max(2 * least_words - 1, 0)
    wanted = (rows.filter(enough).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] * percent) // 100
    last = cutoff(rows.filter(enough), wanted)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        drawn, rest = rows.limit(0), rows
    else:
        key, share = last
        mine = F.when(~enough | ~_at_most(key), 0).when(_exactly(key), share).otherwise(F.col("copies"))
        split = rows.withColumn("mine", mine)
        drawn = split.filter("mine > 0").withColumn("copies", F.col("mine").cast("long")).drop("mine")
        rest = split.withColumn("copies", F.col("copies") - F.col("mine")).filter("copies > 0")
    undrawn = rest.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        *columns, F.lit(None).cast("long").alias("rank"))
    return ranked(drawn).select(*columns, "rank").unionByName(undrawn)
