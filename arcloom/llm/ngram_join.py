"""N-gram Jaccard join of documents: rare-first prefixes, length, positional and suffix filters.

A document is the set of hashes of its distinct word ``n``-grams. Documents with equal sets form a *class*, and only
its representative, the smallest ``doc_id``, is joined. Two sets can only reach the threshold if the first
``size - ceil(threshold * size) + 1`` grams of both, in one common order, share a gram. The order is rare first:
occurrences over all documents are counted in a table of ``2**sketch_bits`` hash buckets, so its size is fixed;
buckets only merge counts, and any common order gives the same links.

Prefix rows that share a gram are candidates:

1. Prefixes are dealt by ranges of ``(gram, size, id)``, which splits a gram of any frequency over many tasks, and
   grams of a single document are left out. Each document is paired with the one under its grams whose grams are the
   most common. What is verified gives components that already hold most of every group of near copies.
2. Grams whose documents all lie in one component are done. Under the others, pairs of different components are
   joined if they pass the length filter, the positional filter, a bound of the symmetric difference by the parities of
   ``64 * ODD_WORDS`` bucket counts inside the join, and the suffix filter: the difference of what lies behind the first
   common gram, bounded from below by counts in ``SIGNATURE`` buckets. What is left, and was no star, is verified, so each pair is
   verified once, and the components are final.

Pairs inside a component are never emitted, so a group of ``g`` near copies costs ``g`` rows and not ``g * g``; a pair
of different components that passes the filters is always verified, so no link between components is lost.

Cases: a null or empty text has no gram and no links. A text of fewer than ``n`` words is one gram. Rows that share
a ``doc_id`` share its links; a null ``doc_id`` is returned with the component of its class. Empty tables give
empty results; other columns are ignored. Texts of any length are taken whole, slice by slice; a set is as large as its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.llm import kernels as K
from arcloom.llm.components import components
from arcloom.sources.workspace import store

SIGNATURE = 128
ODD_WORDS = 8
ODD = [f"odd{i}" for i in range(ODD_WORDS)]
SKETCH_BITS = 20
HELD_ROWS = 10_000
FILTER_ROWS = 256
PREFIX_ROWS_PER_TASK = 1_000_000


def _sets(batch_texts: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and the sorted distinct gram hashes of each text, slice by slice."""
    for lo, hi, data, off in K.slices(batch_texts):
        starts, stops, first = K.words(data, off, K.NOT_SPACE)
        hashes = K.word_hashes(data, starts, stops)
        grams = K.gram_hashes(hashes, n)
        out = []
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            else:
                out.append(K.gram_hashes(hashes[a:b], b - a) if b > a else grams[:0])
        yield lo, out


def gram_counts(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """Occurrences of all grams of all documents in ``2**bits`` buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, sets in _sets(batch.column(0), n):
                at = np.concatenate(sets) & np.uint64((1 << bits) - 1)
                np.add.at(total, at.astype(np.int64), 1)
        yield K.sketch_parts(total, 8)

    parts = docs.select("text").mapInArrow(count, K.SKETCH_SCHEMA)
    return K.collect_sketch(parts, np.uint32, lambda a, b: np.minimum(a.astype(np.uint64) + b, 2**32 - 1).astype(np.uint32))


def _prefixes(n: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        for batch in batches:
            for lo, sets in _sets(batch.column(1), n):
                sizes, digests, signs, odd, prefixes = [], [], [], [], []
                for s in sets:
                    m = len(s)
                    sizes.append(m)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if m else None)
                    signs.append(np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=SIGNATURE), 255).astype(np.uint8).tobytes())
                    odd.append(np.packbits(np.bincount((s & np.uint64(64 * ODD_WORDS - 1)).astype(np.int64), minlength=64 * ODD_WORDS) & 1))
                    keep = m - -(-percent * m // 100) + 1 if m else 0
                    if keep:
                        rare = seen[(s & np.uint64(len(seen) - 1)).astype(np.int64)]
                        s = s[np.lexsort((s, rare))[:keep]]
                    prefixes.append(s[:keep].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(sets)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(signs, pa.binary()), pa.array(prefixes, pa.binary()),
                     *[pa.array(o) for o in np.ascontiguousarray(np.array(odd).view(np.int64).T)]],
                    ["doc_id", "size", "digest", "sign", "prefix", *ODD])

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per prefix gram."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            blobs = part.column("prefix").to_pylist()
            counts = np.array([len(b) // 8 for b in blobs])
            total = int(counts.sum())
            pos = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(blobs), np.int64)), pa.array(np.repeat(part.column("size").to_numpy(), counts).astype(np.int32)),
                 pa.array(np.repeat(part.column("id").to_numpy(), counts)), pa.array(pos.astype(np.int32))],
                ["gram", "size", "id", "pos"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by gram, those that share it; the rows of the first and the last gram of a task always stay."""
    first, held = None, None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        gram = batch.column(0).to_numpy()
        first = gram[0] if first is None else first
        same = gram[1:] == gram[:-1]
        keep = np.zeros(len(gram), bool)
        keep[1:] = same
        keep[:-1] |= same
        keep |= gram == first
        tail = int(np.searchsorted(gram, gram[-1]))
        rest = batch.slice(tail)
        if tail:
            yield batch.slice(0, tail).filter(pa.array(keep[:tail]))
        if rest.num_rows > HELD_ROWS:
            yield rest.slice(0, rest.num_rows - 2)
            rest = rest.slice(rest.num_rows - 2)
        held = rest
    if held is not None:
        yield held


def _verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the threshold.

    Sets are built again from the texts, for the documents in ``pairs``, which a bitmap of fixed size chooses.
    """
    wanted = K.ship(docs, K.collect_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(K.in_bitmap(wanted.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for lo, found in _sets(batch.column(1), n):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(found)), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    grams = docs.filter(F.col("doc_id").isNotNull()).mapInArrow(sets, "id long, grams binary")
    left = pairs.join(grams.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
    both = left.join(grams.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
    return both.select("a", "b", "grams_a", "grams_b").mapInArrow(compare, "a long, b long").distinct()


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE).astype(np.int32)


def _prefix_counts(prefixes: pa.Array, upto: np.ndarray) -> np.ndarray:
    """Bucket counts of the first ``upto`` grams of each prefix."""
    grams = [np.frombuffer(p.as_buffer(), np.uint64)[:n] for p, n in zip(prefixes, upto.tolist())]
    buckets = (np.concatenate(grams) >> np.uint64(57)).astype(np.int64)
    rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    return np.bincount(rows * SIGNATURE + buckets, minlength=len(grams) * SIGNATURE).reshape(-1, SIGNATURE)


def suffix_bound(batch: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A lower bound of the symmetric difference behind the first common gram, and the most that the threshold allows there.

    The sets behind that gram are counted in ``SIGNATURE`` buckets: those of the whole set less those of the grams up to it.
    Buckets that are full in either set say nothing. Position -1 stands for the whole sets.
    """
    size, upto, counts, full = [], [], [], []
    for side in "ab":
        size.append(batch.column(f"size_{side}").to_numpy())
        upto.append(batch.column(f"pos_{side}").to_numpy() + 1)
        whole = _signs(batch.column(f"sign_{side}"))
        counts.append(whole - _prefix_counts(batch.column(f"prefix_{side}"), upto[-1]))
        full.append(whole == 255)
    least = -(-percent * (size[0] + size[1]) // (100 + percent))
    most = size[0] - upto[0] + size[1] - upto[1] - 2 * (least - (upto[0] > 0))
    apart = np.abs(counts[0] - counts[1])
    apart[full[0] | full[1]] = 0
    return apart.sum(1), most


def _filtered(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b, pos_a, pos_b)``, one row each, after the suffix filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILTER_ROWS):
                part = batch.slice(at, FILTER_ROWS)
                apart, most = suffix_bound(part, percent)
                yield part.select(["a", "b"]).filter(pa.array(apart <= most))

    joined = pairs
    for side in "ab":
        joined = joined.join(reps.select(*[F.col(c).alias(f"{n}_{side}" if c != "id" else side) for c, n in (
            ("id", ""), ("size", "size"), ("sign", "sign"), ("prefix", "prefix"))]), side)
        # Only the grams up to the first common one are sent; a long document's prefix is far longer.
        joined = joined.withColumn(f"prefix_{side}", F.substring(f"prefix_{side}", F.lit(1), (F.col(f"pos_{side}") + 1) * 8))
    return joined.mapInArrow(run, "a long, b long")


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, class_id)`` per row of ``docs (doc_id, text)``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id that links reach.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = K.ship(docs, gram_counts(docs, n, sketch_bits))
    base = store(docs.mapInArrow(_prefixes(n, percent, counts), "doc_id long, size long, digest binary, sign binary, prefix binary, " + ", ".join(f"{o} long" for o in ODD)), "prefixes")
    classes = store(base.filter("size > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes")
    reps = base.join(classes.filter("class_id is not null"), (base["digest"] == classes["digest"]) & (base["doc_id"] == F.col("class_id"))).select(
        F.col("doc_id").alias("id"), "size", "sign", "prefix", *ODD).dropDuplicates(["id", "prefix"])
    reps = store(reps, "representatives")
    tasks = _tasks(reps)
    rows = reps.select("id", "size", "prefix").mapInArrow(_explode, "gram long, size int, id long, pos int")
    rows = rows.repartitionByRange(tasks, "gram", "size", "id").sortWithinPartitions("gram", "size", "id")
    shared = store(rows.mapInArrow(_shared, "gram long, size int, id long, pos int"), "shared-grams")
    popular = shared.groupBy("gram").agg(F.count("*").alias("n"))
    weights = shared.join(popular, "gram").groupBy("id").agg(F.sum("n").alias("weight"))
    shared = store(shared.join(weights, "id"), "weighted-grams")
    placed = shared.withColumn("component", F.col("id"))
    stars = store(_filtered(_stars(placed, percent), reps, percent), "star-pairs")
    grouped = components(store(_verify(stars, docs, n, percent), "star-links"))
    placed = store(shared.join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    mixed = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("gram")
    open_rows = store(placed.join(mixed, "gram").join(reps.select("id", *ODD), "id"), "open-grams")
    pairs = _open_pairs(open_rows, percent)
    # What was verified as a star, with or without success, is not verified again.
    tested = stars.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    pairs = pairs.join(tested, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")
    pairs = store(_filtered(pairs, reps, percent), "open-pairs")
    further = _verify(pairs, docs, n, percent)
    bridges = _between(further, grouped)
    tops = components(bridges)
    # A left join, which can be split where one component holds very many documents; then the documents that only bridges link.
    moved = tops.select(F.col("id").alias("component"), F.col("component").alias("top"))
    named = grouped.join(moved, "component", "left").select(F.col("id").alias("class_id"), F.coalesce("top", "component").alias("component")).unionByName(
        tops.join(grouped.select("id"), "id", "left_anti").select(F.col("id").alias("class_id"), "component"))
    return base.join(classes, "digest", "left").join(named, "class_id", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "class_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"))


def _open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components under one gram after the length, positional and parity filters."""
    sides = [rows.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("size", "id", "pos", "component", *ODD)]) for side in "ab"]
    sizes = F.col("size_a") + F.col("size_b")
    overlap = F.least("pos_a", "pos_b") + F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    least = F.ceil(F.lit(percent) * sizes / F.lit(100 + percent))
    differing = sum((F.bit_count(F.col(f"{o}_a").bitwiseXOR(F.col(f"{o}_b"))) for o in ODD), F.lit(0))
    return sides[0].join(sides[1], "gram").filter(
        (F.col("component_a") != F.col("component_b")) & (100 * F.col("size_a") >= percent * F.col("size_b"))
        & ((F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("id_a") < F.col("id_b"))))
        & (overlap >= least) & (differing <= sizes - 2 * least)
    ).groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.min("pos_a").alias("pos_a"), F.min("pos_b").alias("pos_b"))


def _stars(placed: DataFrame, percent: int) -> DataFrame:
    """Documents with one under one of their grams whose grams are the most common: in a group of near copies that is
    the one with the fewest changes. One pair a document, each pair once, of the whole sets."""
    members = placed.groupBy("gram").agg(F.max(F.struct("weight", F.col("id").alias("hub"), F.col("size").alias("hub_size"))).alias("top"))
    rows = placed.join(members.select("gram", "top.hub", "top.hub_size"), "gram")
    close = (100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")) & (F.col("id") != F.col("hub"))
    best = rows.filter(close).groupBy("id", "hub").agg(F.count("*").alias("common")).groupBy("id").agg(F.max(F.struct("common", "hub")).alias("best"))
    return best.select(F.least("best.hub", "id").alias("a"), F.greatest("best.hub", "id").alias("b")).distinct().withColumns(
        {"pos_a": F.lit(-1), "pos_b": F.lit(-1)})


def _between(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Links between documents as links between their components."""
    named = pairs
    for side in ("a", "b"):
        top = grouped.select(F.col("id").alias(side), F.col("component").alias(f"top_{side}"))
        named = named.join(top, side, "left")
    return named.select(F.coalesce("top_a", "a").alias("a"), F.coalesce("top_b", "b").alias("b")).distinct()


def _tasks(reps: DataFrame) -> int:
    grams = reps.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    return max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(grams // PREFIX_ROWS_PER_TASK) + 1)
