"""Byte-level BPE encoding and decoding with a given vocabulary of ranks.

Texts of up to ``chunk`` characters are pre-tokenised and encoded where they are read. A longer text is cut into
chunks that overlap by ``overlap`` characters and lie in rows of their own. Every chunk is pre-tokenised in parallel,
from its own first character on. The pattern only looks forward, so once two scans meet at a boundary they agree
for good: a chunk's piece starts at the first boundary that it shares with the scan of the chunk before, inside
their overlap. Boundaries at the very end of a chunk, where the pattern has not seen the next character, do not
count. Then the pieces are encoded, in parallel again, and put together in order. A text in which two
neighbours share no boundary (a single run of one character class longer than the overlap) is encoded whole.

Decoding puts the raw bytes of the ids together; a character may be split between ids.

Cases: null is the empty text and gives no ids. Special tokens are ordinary text. Repeated rows are encoded each;
long equal texts once. All columns of the input stay; ``ids`` (little-endian unsigned 32-bit) is added, in place of a column of
that name. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcloom.sources.workspace import store

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
CHUNK = 1 << 15
OVERLAP = 1 << 11
CACHED_PIECES = 1 << 16
BATCH_BYTES = 4 << 20


class Pieces(dict):
    """Packed ids of each pre-token; a bounded memory of those met lately."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        ids = np.array(self.bpe.encode_single_piece(piece.encode()), "<u4").tobytes()
        self[piece] = ids
        return ids


class Codec:
    """A vocabulary, loaded once per Python worker."""

    loaded: dict = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.scan = regex.compile(pattern).finditer
        self.pieces = Pieces(self.ranks)
        self.tokens = {i: b for b, i in self.ranks.items()}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls.loaded:
            cls.loaded[path, pattern] = cls(path, pattern)
        return cls.loaded[path, pattern]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode_start(self, text: str, keep: int | None) -> bytes:
        """Ids of the pre-tokens that begin before ``keep``; what follows is there for the pattern to look at."""
        if keep is None:
            return self.encode(text)
        return b"".join([self.pieces[m.group()] for m in self.scan(text) if m.start() < keep])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def boundaries(self, text: str) -> list[int]:
        return [m.start() for m in self.scan(text)]


def _mapped(df: DataFrame, source: str, name: str, kind, work) -> DataFrame:
    """``df`` with a binary column ``name`` made from ``source``, in batches of a few MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, size = 0, [], 0
            column = batch.column(source)
            for i, value in enumerate(column):
                out.append(work(value.as_py()))
                size += len(out[-1] or b"")
                if size >= BATCH_BYTES or i + 1 == len(column):
                    part = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], [*batch.schema.names, name])
                    at, out, size = i + 1, [], 0

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))


def _encoded(df: DataFrame, path: str, pattern: str, text="text") -> DataFrame:
    return _mapped(df, text, "ids", pa.binary(), lambda t: Codec.of(path, pattern).encode(t or ""))


def decode(df: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Adds ``bytes``, the raw bytes of ``ids``; null ids give null."""
    return _mapped(df, "ids", "bytes", pa.binary(), lambda x: None if x is None else Codec.of(path, pattern).decode(x))


def chunks_of(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``(key, no, n, text)``: overlapping chunks of ``(key, text)``; equal texts once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                starts = range(0, len(text), chunk)
                for lo in range(0, len(starts), 64):
                    part = starts[lo : lo + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(part)), pa.array([s // chunk for s in part], pa.int32()),
                         pa.array([len(starts)] * len(part), pa.int32()), pa.array([text[s : s + chunk + overlap] for s in part])],
                        ["key", "no", "n", "text"])

    return texts.mapInArrow(cut, "key string, no int, n int, text string").dropDuplicates(["key", "no"])


def _ends(path: str, pattern: str, chunk: int, overlap: int):
    """Boundaries in the first and last ``overlap`` characters of each chunk, counted from the start of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            found = [np.array(codec.boundaries(t.as_py()), np.int32) for t in batch.column(3)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([b[b < overlap] for b in found], kind), pa.array([b[b >= chunk] - chunk for b in found], kind)],
                ["key", "no", "n", "head", "tail"])

    return run


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``ids``, the packed token ids of ``text``."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap has to be within a chunk")
    docs = docs.drop("ids")
    size = F.length(F.coalesce("text", F.lit("")))
    short = _encoded(docs.filter(size <= chunk), path, pattern)
    long = docs.filter(size > chunk)
    keyed = long.select(F.md5("text").alias("key"), "text")
    chunks = store(chunks_of(keyed, chunk, overlap), "chunks")
    if chunks.isEmpty():
        return short
    ends = store(chunks.mapInArrow(_ends(path, pattern, chunk, overlap), "key string, no int, n int, head array<int>, tail array<int>"), "chunk-ends")
    before = ends.select("key", (F.col("no") + 1).alias("no"), F.col("tail").alias("before"))
    starts = ends.join(before, ["key", "no"], "left").select(
        "key", "no", "n", F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "before"))).alias("start"))
    starts = store(starts, "piece-starts")
    whole = starts.filter(F.col("start").isNull()).select("key").distinct()
    after = starts.select("key", (F.col("no") - 1).alias("no"), (F.col("start") + chunk).alias("stop"))
    cuts = starts.join(after, ["key", "no"], "left").join(whole, "key", "left_anti")
    # A piece comes with the rest of its chunk, since the pattern may look past the piece's end.
    piece = F.struct(F.substring("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("text"), (F.col("stop") - F.col("start")).alias("keep"))
    pieces = chunks.join(cuts.select("key", "no", "start", "stop"), ["key", "no"]).select("key", "no", piece.alias("piece"))
    stitched = (
        _mapped(pieces, "piece", "ids", pa.binary(), lambda p: Codec.of(path, pattern).encode_start(p["text"], p["keep"]))
        .select("key", "no", "ids").groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts"))
        .select("key", F.col("parts.ids").alias("parts"))
    )
    joined = _mapped(stitched, "parts", "ids", pa.binary(), b"".join).select("key", "ids")
    rest = _encoded(keyed.join(whole, "key", "left_semi").dropDuplicates(["key"]), path, pattern).select("key", "ids")
    done = joined.unionByName(rest)
    return short.unionByName(long.join(done, F.md5(long["text"]) == done["key"]).select(*[long[c] for c in docs.columns], done["ids"]))
