"""Numpy kernels on Arrow batches of texts: words, their hashes, word n-grams and bounded hash sketches.

A batch is worked on in slices of about ``SLICE_BYTES``, so memory does not depend on the batch. A single text
larger than that is a slice of its own. Hashes are 64 bits wide: bytes are mapped through a fixed random table,
summed with the powers of an odd number modulo 2**64 and mixed, so equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RANDOM.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}

WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Byte classes of words: everything but white space; ASCII letters, digits and all bytes from 0x80.
NOT_SPACE = np.array([b not in WHITE_SPACE for b in range(256)])
ALPHANUMERIC = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(SLICE_BYTES + 1, 1 << n.bit_length() if n > SLICE_BYTES + 1 else 0)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            out = np.full(size, np.uint64(base))
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive rows, without a copy; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if texts.type == pa.large_string() else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the index of its first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    w = is_word[data]
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    inner = off[off < len(data)]
    before[inner] = False
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    ends = off[(off > 0)] - 1
    after[ends] = False
    starts, stops = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, stops, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    values = (_TABLE[LOWER] if lower else _TABLE)[data]
    values *= up[: len(values)]
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts])


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` hashes; runs across texts are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)


def inside(first: np.ndarray, length: int, total: int) -> np.ndarray:
    """For each of ``total`` items: does a run of ``length`` from here stay within its text?"""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(total)
    return at + length <= first[text + 1]


def row_lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Consecutive values as one list per row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def binary_rows(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


def byte_strings(matrix: np.ndarray) -> pa.Array:
    """The rows of a contiguous 2-d array as binary values of equal length."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.strides[0] if matrix.ndim == 2 and len(matrix) else 0
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


SKETCH_SCHEMA = "part int, counts binary"


def sketch_parts(counts: np.ndarray, pieces: int) -> pa.RecordBatch:
    """A task's counters, cut into ``pieces`` so that no reducer gets more than its share."""
    cut = np.array_split(counts, pieces)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(pieces), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], ["part", "counts"])


def collect_sketch(parts: DataFrame, dtype, join) -> np.ndarray:
    """Combine the counters of all tasks on the executors; only the fixed-size total reaches the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(blob, dtype)
                total[part] = join(total[part], x) if part in total else x
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])

    merged = parts.repartition("part").mapInArrow(merge, SKETCH_SCHEMA)
    rows = sorted(merged.collect(), key=lambda r: r["part"])
    return np.concatenate([np.frombuffer(bytes(r["counts"]), dtype) for r in rows]) if rows else np.zeros(0, dtype)


BITMAP_BITS = 1 << 23


def collect_bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of fixed size in which the low bits of each 64-bit key are set.

    It serves as a semi-join reduction: keys that are not in it are not in ``keys``. More keys only mean more
    false positives, which the join behind it removes; none is ever lost.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            x = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
            seen[mix(x) & np.uint64(bits - 1)] = True
        if seen.any():
            yield sketch_parts(np.packbits(seen, bitorder="little"), 8)

    bitmap = collect_sketch(keys.select(F.col(column)).mapInArrow(mark, SKETCH_SCHEMA), np.uint8, np.bitwise_or)
    return bitmap if len(bitmap) else np.zeros(bits // 8, np.uint8)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = mix(keys.astype(np.int64, copy=False).view(np.uint64)) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def ship(df: DataFrame, value):
    """A broadcast of a value whose size is fixed by its parameters."""
    return df.sparkSession.sparkContext.broadcast(value)
