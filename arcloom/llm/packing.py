"""Packing of tokenised documents into sequences of equal attention cost and hardly any padding.

A document is its token ids and an end id. What fills whole sequences is cut off first, a sequence each; the last piece of every
document is packed with others. The cost of a piece of ``L`` tokens is ``linear * L + quadratic * L**2``, since tokens attend within
their document only; documents in descending order go to the sequence with the lowest cost so far among those with room for
all of it. Where none has, the document is cut to fill the roomiest one, and its rest takes its place in the order.

A task packs what it reads, in groups of ``group`` sequences that are filled to the last token: the document that crosses the end of a
group is cut there and opens the next one. Less than one sequence is left per task; these remains are packed once more, in as
many tasks as they fill groups, so there is no shuffle of ids and no task holds more than a group. Only the very last sequence
of each of those tasks is padded, or spread as free places over its last group.

White space only parts the words for this vocabulary, so the ids of a text are those of its words, and each worker keeps the ids
of up to ``CACHED_WORDS`` words of at most ``CACHED_BYTES`` bytes. Texts are split in blocks of ``BLOCK`` bytes at white space.

Cases: null and empty texts are the end id alone. Null ids and repeated rows are documents like others, each packed; ties go to the
document read first and to the sequence with the smallest number. A text of any length is tokenised in its row, its whole
sequences leave in parts of a few MB. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.llm import kernels as K
from arcloom.sources.workspace import store

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 4096
END = 2
GROUP = 256
#: Of a model whose hidden size is 2048: attention adds L / (6 * 2048) to the cost of a token.
LINEAR, QUADRATIC = 1.0, 1 / 12288
CACHED_WORDS, CACHED_BYTES = 1 << 20, 64
BLOCK = 1 << 20
PART_BYTES = 4 << 20
#: Characters below it have no combining marks among them; the dotted capital I alone has a lower case of two characters.
SIMPLE = "\u0180"
#: How the merges see bytes: printable ones as themselves, others in order from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_COLUMNS = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]


class Words:
    """Packed ids of words; the vocabulary is loaded once per Python worker.

    Printable words of characters below ``SIMPLE`` are lower-cased and cut by the file's own pattern, and each piece goes straight to
    the merges, if the file says that this is all it does to them (no such character composes with another); other words
    pass through the whole tokenizer, many at once, parted by a special token.
    """

    loaded: dict[str, Words] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.pieces = Tokenizer.from_file(path), {}, {}
        self.merges = self.tokenizer.model.tokenize
        steps = json.loads(self.tokenizer.to_str())
        special = [t for t in steps["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        self.mark = special[0] if special else None
        self.added = re.compile("|".join([re.escape(t["content"]) for t in steps["added_tokens"]]) or "(?!)", re.IGNORECASE)
        kinds = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])]
        split, *rest = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        plain = kinds == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") and [
            (r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest] == [("ByteLevel", False, False)]
        self.cut = regex.compile(split["pattern"]["Regex"]).findall if plain else None

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def _piece(self, piece: str) -> bytes:
        seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_VISIBLE)
        ids = array("I", [t.id for t in self.merges(seen)]).tobytes()
        if len(piece) <= CACHED_BYTES:
            self.pieces[piece] = ids
        return ids

    def _whole(self, words: list[str]) -> list[bytes]:
        """Ids of words by the whole tokenizer; those that hold an added token one by one."""
        if self.mark is None or any(map(self.added.search, words)):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        out = []
        for lo in range(0, len(words), 256):
            text = self.mark["content"].join(words[lo : lo + 256])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            out += [part.tobytes() for part in np.split(ids, np.flatnonzero(ids == self.mark["id"]))]
            # Every part but the first of a block starts with the mark.
            out[lo + 1 :] = [part[4:] for part in out[lo + 1 :]]
        return out

    def _fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        out, others, pieces, simple = {}, [], self.pieces, self.cut is not None
        for word in words:
            text = word.decode()
            if not simple or not text.isprintable() or not (text.isascii() or max(text) < SIMPLE and "İ" not in text) or "<|" in text:
                others.append((word, text))
            else:
                out[word] = b"".join([pieces.get(p) or self._piece(p) for p in self.cut(text.lower())])
        out.update(zip([w for w, _ in others], self._whole([t for _, t in others])))
        return out

    def ids(self, texts: list[list[bytes]]) -> list[bytes]:
        """Packed ids of texts that are given as their words."""
        for cache in (self.known, self.pieces):
            if len(cache) >= CACHED_WORDS:
                cache.clear()
        # Most words of a slice recur in it: the large cache is asked once for each.
        distinct = list(set().union(*texts))
        local = dict(zip(distinct, map(self.known.get, distinct)))
        missing = [w for w, ids in local.items() if ids is None]
        if missing:
            fresh = self._fresh(missing)
            local.update(fresh)
            self.known.update((w, ids) for w, ids in fresh.items() if len(w) <= CACHED_BYTES)
        return [b"".join(map(local.__getitem__, t)) for t in texts]

    def whole(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            found = _SPACE.search(text, min(at + BLOCK, len(text)))
            stop = found.start() if found else len(text)
            out += self.ids([text[at:stop].split()])
            at = stop
        return b"".join(out)


def token_ids(texts: pa.Array, words: Words) -> Iterator[list[bytes]]:
    """Packed ids of consecutive texts, a slice of rows at a time."""
    for lo, hi, data, off in K.slices(texts):
        raw = data.tobytes()
        if hi - lo == 1 and len(raw) > BLOCK:
            yield [words.whole(raw)]
        else:
            yield words.ids([raw[a:b].split() for a, b in zip(off[:-1], off[1:])])


def balance(lengths: list[int], sequences: int, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """``(item, start, length, sequence, offset)`` of all pieces of items of at most ``capacity`` tokens that fit in together."""
    cost, room = np.zeros(sequences), np.full(sequences, capacity)
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    out = []
    while queue:
        n, item, start = heapq.heappop(queue)
        n = -n
        fits = room >= n
        if fits.any():
            to, put = int(np.where(fits, cost, np.inf).argmin()), n
        else:
            to = int(room.argmax())
            put = int(room[to])
            heapq.heappush(queue, (put - n, item, start + put))
        out.append((item, start, put, to, capacity - int(room[to])))
        cost[to] += linear * put + quadratic * put * put
        room[to] -= put
    return out


class Packer:
    """Groups of one task: takes pieces, gives rows of ``_COLUMNS``."""

    def __init__(self, capacity: int, group: int, linear: float, quadratic: float, level: int):
        self.capacity, self.full, self.costs = capacity, group * capacity, (linear, quadratic)
        self.items, self.tokens, self.sequences = [], 0, (2 * TaskContext.get().partitionId() + level) << 32
        self.rows, self.bytes = [], 0

    def emit(self, doc, start: int, ids: bytes, size: int, sequence: int | None, offset: int | None) -> None:
        self.rows.append((doc, start, len(ids) // 4, size, ids, sequence, offset))
        self.bytes += len(ids)

    def add(self, doc, start: int, ids: bytes, size: int) -> None:
        """The piece ``ids`` at ``start`` of a document of ``size`` tokens."""
        step, at = 4 * self.capacity, 0
        while len(ids) - at >= step:
            self.emit(doc, start + at // 4, ids[at : at + step], size, self.sequences, 0)
            self.sequences += 1
            at += step
        if at < len(ids):
            self.items.append((doc, start + at // 4, ids[at:] if at else ids, size))
            self.tokens += (len(ids) - at) // 4
        if self.tokens >= self.full:
            self.close(self.full)

    def close(self, tokens: int) -> None:
        """Pack the first ``tokens`` of the open items; the last one is cut there."""
        rest = []
        over = self.tokens - tokens
        while over > 0:
            doc, start, ids, size = self.items.pop()
            keep = max(0, len(ids) // 4 - over)
            over -= len(ids) // 4 - keep
            rest.append((doc, start + keep, ids[4 * keep :], size))
            if keep:
                self.items.append((doc, start, ids[: 4 * keep], size))
        count = -(-tokens // self.capacity)
        for item, at, n, sequence, offset in balance([len(i[2]) // 4 for i in self.items], count, self.capacity, *self.costs):
            doc, start, ids, size = self.items[item]
            self.emit(doc, start + at, ids[4 * at : 4 * (at + n)], size, self.sequences + sequence, offset)
        self.sequences += count
        self.items = rest[::-1]
        self.tokens = sum(len(i[2]) // 4 for i in self.items)

    def batch(self, kinds: pa.Schema) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), kinds.types)], schema=kinds)
        self.rows, self.bytes = [], 0
        return out


def _kinds(doc: pa.DataType) -> pa.Schema:
    types = [doc, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.schema(list(zip(_COLUMNS, types)))


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str = VOCABULARY, group: int = GROUP, linear: float = LINEAR,
         quadratic: float = QUADRATIC) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids, sequence_id, offset)`` of every piece of ``docs (doc_id, text)``, stored.

    ``ids`` are packed as little-endian unsigned 32-bit integers, ``start`` and ``doc_tokens`` count the ids of the document with its end.
    """
    if capacity < 1 or group < 1:
        raise ValueError("sequences need a token and groups a sequence")
    closing = np.array([end], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kinds, words = Packer(capacity, group, linear, quadratic, 0), None, Words.of(path)
        for batch in batches:
            kinds, at = _kinds(batch.schema.types[0]), 0
            named = batch.column(0).to_pylist()
            for part in token_ids(batch.column(1), words):
                for ids in part:
                    packer.add(named[at], 0, ids + closing, len(ids) // 4 + 1)
                    at += 1
                    if packer.bytes >= PART_BYTES:
                        yield packer.batch(kinds)
        if packer.tokens >= capacity:
            packer.close(packer.tokens - packer.tokens % capacity)
        for doc, start, ids, size in packer.items:
            packer.emit(doc, start, ids, size, None, None)
        if packer.rows:
            yield packer.batch(kinds)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kinds = Packer(capacity, group, linear, quadratic, 1), None
        for batch in batches:
            kinds = _kinds(batch.schema.types[0])
            for doc, start, size, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                packer.add(doc, start, ids, size)
                if packer.bytes >= PART_BYTES:
                    yield packer.batch(kinds)
        if packer.tokens:
            packer.close(packer.tokens)
        if packer.rows:
            yield packer.batch(kinds)

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    packed = store(docs.select("doc_id", "text").mapInArrow(first, kind), "packed-pieces")
    remains = packed.filter(F.col("sequence_id").isNull())
    tokens = remains.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-tokens // (group * capacity)))
    again = store(remains.select("doc_id", "start", "doc_tokens", "ids").coalesce(tasks).mapInArrow(last, kind), "packed-remains")
    return packed.filter(F.col("sequence_id").isNotNull()).unionByName(again)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """``(sequence_id, ids, doc_ids, lengths)``: one row per sequence, padded to ``capacity``; a row gathers at most that many tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", F.hex("ids").alias("hex"))))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    padding = np.array([pad], "<u4").tobytes().hex()
    return rows.select(
        "sequence_id", F.unhex(F.rpad(F.array_join("parts.hex", ""), 8 * capacity, padding)).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))
