"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters, digits and non-ASCII bytes, ``A-Z`` lower-cased. A *window* is ``length``
consecutive item words; an item of fewer words is one window of its own length. Every text keeps the least hash
(the rightmost of equals) of each run of ``w`` consecutive ``k``-grams with ``k + w - 1 = length``: two texts that
share a window keep the same fingerprint inside it. Fingerprints of both sides are joined, and each hit is extended
word by word to both sides; a run of at least ``length`` equal words is an occurrence. A fingerprint carries the
hashes of the words a window around it can reach, so texts are read once and never shuffled.

Short items get fingerprints for their own length, one pass of numpy per length below ``length`` that occurs.
The fingerprints of the documents are reduced by a bitmap of fixed size of the item fingerprints before the shuffle.

Cases: null and empty texts have no words, are never hit and, as items, hit nothing. Repeated rows get equal results.
Equal texts are looked up once. Other columns of the input are ignored. Empty tables give an empty or clean result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.llm import kernels as K
from arcloom.sources.workspace import store

LENGTH = 10
_FOUND = "n_words long, found array<struct<size:int,fp:long,pos:int,near:binary>>"
_FOUND_TYPE = pa.struct([("size", pa.int32()), ("fp", pa.int64()), ("pos", pa.int32()), ("near", pa.binary())])


def gram_size(length: int) -> tuple[int, int]:
    """``(k, w)`` with ``k + w - 1 = length``."""
    k = max(1, length // 2)
    return k, length - k + 1


def winnow(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the fingerprints of all texts; ``first`` bounds the words of each text."""
    k, w = gram_size(length)
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = K.gram_hashes(hashes, k)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        lower = grams[j : j + n] <= best
        best[lower] = grams[j : j + n][lower]
        at[lower] = j
    ok = K.inside(first, length, len(hashes))[:n]
    pos = np.unique((np.arange(n) + at)[ok])
    return pos, grams[pos]


def _near(hashes: np.ndarray, first: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the words within reach of the gram at each position, 0 beyond its text."""
    k, _ = gram_size(length)
    reach = length - k
    text = np.searchsorted(first, pos, side="right") - 1
    at = pos[:, None] + np.arange(-reach, k + reach)[None, :]
    ok = (at >= first[text][:, None]) & (at < first[text + 1][:, None])
    return np.where(ok, hashes[np.clip(at, 0, len(hashes) - 1)], np.uint64(0))


def _salted(fp: np.ndarray, length: int) -> np.ndarray:
    return K.mix(fp ^ np.uint64(length)).view(np.int64)


def _fingerprints(lengths: list[int], bitmap=None):
    """Kernel for rows that end in ``text``; the columns before it are passed on.

    With a bitmap, fingerprints that are not in it are left out. Without one the rows are items, and each has
    the fingerprints of the one length that is its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if bitmap is None else bitmap.value
        for batch in batches:
            names, rest = batch.schema.names[:-1], batch.columns[:-1]
            for lo, hi, data, off in K.slices(batch.column(batch.num_columns - 1)):
                starts, stops, first = K.words(data, off, K.ALPHANUMERIC)
                hashes = K.word_hashes(data, starts, stops)
                hashes[hashes == 0] = 1
                n_words = np.diff(first)
                text, size, fps, at, near = [], [], [], [], []
                for length in lengths:
                    pos, fp = winnow(hashes, first, length)
                    owner = np.searchsorted(first, pos, side="right") - 1
                    fp = _salted(fp, length)
                    if marks is not None:
                        ok = K.in_bitmap(marks, fp)
                    else:
                        ok = np.minimum(n_words[owner], lengths[-1]) == length
                    pos, fp, owner = pos[ok], fp[ok], owner[ok]
                    text.append(owner)
                    size.append(np.full(len(pos), length, np.int32))
                    fps.append(fp)
                    at.append(pos - first[owner])
                    near.extend(r.tobytes() for r in (_near(hashes, first, pos, length) if len(pos) else ()))
                text, size, fps, at = (np.concatenate(x) for x in (text, size, fps, at))
                order = np.argsort(text, kind="stable")
                found = pa.StructArray.from_arrays(
                    [pa.array(size[order], pa.int32()), pa.array(fps[order], pa.int64()), pa.array(at[order].astype(np.int32)),
                     pa.array([near[i] for i in order], pa.binary())], fields=list(_FOUND_TYPE))
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in rest], pa.array(n_words, pa.int64()),
                     K.row_lists(found, np.bincount(text, minlength=hi - lo))], [*names, "n_words", "found"])

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, item_key, begin, stop`` of the runs of equal words around joined fingerprints, where long enough."""
    for batch in batches:
        size = batch.column("size").to_numpy()
        out = []
        for length in np.unique(size):
            k, _ = gram_size(int(length))
            reach = int(length) - k
            rows = np.flatnonzero(size == length)
            part = batch.take(pa.array(rows))
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(len(rows), -1) for c in ("near", "item_near"))
            same = (a == b) & (a != 0)
            left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(1)
            right = np.cumprod(same[:, reach + k :], axis=1).sum(1)
            ok = same[:, reach : reach + k].all(1) & (left + right + k >= length)
            pos = part.column("pos").to_numpy()
            out.append(pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("item_key"), pa.array((pos - left).astype(np.int32)), pa.array((pos + k + right).astype(np.int32))],
                ["key", "item_key", "begin", "stop"]).filter(pa.array(ok)))
        yield from out


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs (doc_id, text)`` against ``items (item_id, text)``.

    ``doc_id, n_words, n_hit, item_ids (sorted as strings), spans``: ``spans`` are the distinct hit runs of words.
    """
    key = F.md5(F.coalesce("text", F.lit("")))
    item_rows = items.filter(F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), key.alias("key"), "text")
    item_fp = store(item_rows.dropDuplicates(["key"]).select("key", "text").mapInArrow(
        _fingerprints(list(range(1, length + 1))), f"key string, {_FOUND}"), "item-fingerprints")
    item_fp = item_fp.select("key", F.explode("found").alias("f")).select(
        F.col("key").alias("item_key"), "f.size", "f.fp", F.col("f.near").alias("item_near")).distinct()
    lengths = sorted(r["size"] for r in item_fp.select("size").distinct().collect()) or [length]
    bitmap = K.ship(docs, K.collect_bitmap(item_fp, "fp"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    base = store(docs.select("doc_id", key.alias("key"), "text").mapInArrow(
        _fingerprints(lengths, bitmap), f"doc_id {doc_type}, key string, {_FOUND}"), "doc-fingerprints")
    found = (
        base.filter(F.size("found") > 0).select("key", F.explode("found").alias("f"))
        .select("key", "f.size", "f.fp", "f.pos", "f.near").dropDuplicates(["key", "size", "pos"])
    )
    runs = found.join(item_fp, ["size", "fp"]).select("key", "item_key", "size", "pos", "near", "item_near").mapInArrow(
        _extend, "key string, item_key string, begin int, stop int").distinct()
    runs = store(runs, "runs")
    spans = runs.select("key", "begin", "stop").distinct()
    hits = (
        spans.select("key", F.explode(F.sequence("begin", F.col("stop") - 1)).alias("word")).distinct()
        .groupBy("key").agg(F.count("*").alias("n_hit"))
        .join(spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("spans")), "key")
    )
    ids = item_rows.select(F.col("key").alias("item_key"), "item_id").distinct()
    lists = (
        runs.select("key", "item_key").distinct().join(ids, "item_key").select("key", "item_id").distinct()
        .groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    )
    # Stored, so that the join with it is of two plain tables and Spark can split a text that very many rows share.
    result = store(hits.join(lists, "key", "left"), "hit-texts")
    return base.select("doc_id", "key", "n_words").join(result, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<begin:int,stop:int>>")).alias("spans"))


def clean_rows(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs; all columns stay.

    The texts of hit rows are known by digest, so rows without a ``doc_id`` and repeated ids are decided by their text.
    """
    hit = contamination(docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("doc_id"), "text"), items, length)
    bad = hit.filter(F.col("n_hit") > 0).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.md5(F.coalesce(docs["text"], F.lit(""))) == F.col("_bad"), "left_anti")
