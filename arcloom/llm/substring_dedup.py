"""Substring deduplication by sliding spans of sentences.

A sentence ends after a word that ends in ``. ! ?`` or the ideographic full stop, closing quotes and brackets aside,
and at the end of a line. Inside a sentence, every ``LONG`` words in a row are cut after the one with the least hash, the
last of equals, so a sentence in the sense of this module has at most ``LONG`` words. Whether a cut is made depends on
these words alone: a passage copied into other surroundings is cut at the same words, but for less than ``LONG`` words at
either end. The *spans* are the shortest runs of at least ``sentences`` sentences with at least ``words`` words from every
sentence on, and those up to every sentence. With the defaults, a passage of ``3 * LONG + WORDS - 1 = 39`` words or more
holds the same span in every copy, and all but less than ``LONG`` words at either end are covered. Spans are compared by the
64-bit hash of their words, ``A-Z`` lower-cased, white space aside.

All spans of all documents are dealt by ranges of ``(hash, doc_id, text hash, position)`` and sorted, so that a span
that a third of all documents share is spread over many tasks. The first of each hash, in that order, stays; the
sentences that any other one covers are removed. A task cannot see whether its first span continues the
task before; those rows, one per task, are settled by a join with the last row of every task.

Cases: null stays null and has no sentences. Texts without a span stay as they are, empty ones too. Repeats inside one
text count. Rows with the same ``doc_id``, null or not, and text are one document: they get the same result, and spans that
differ in nothing are one and no repeat of each other. Ties are broken by ``doc_id``
(null first), then text hash. Other columns stay; a column ``n_sentences`` or ``n_removed`` of the input is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcloom.llm import kernels as K
from arcloom.sources.workspace import store

SENTENCES = 2
WORDS = 16
LONG = 8
_CLOSING = np.isin(np.arange(256), list(b"\"')]}"))
_STOP = np.isin(np.arange(256), list(b".!?"))
_WIDE_STOP = (0xE3, 0x80, 0x82)


def _least(hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """The word with the least hash, the last of equals, of every ``LONG`` words inside one sentence."""
    n = len(hashes) - LONG + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, LONG):
        smaller = hashes[j : j + n] <= least
        np.copyto(least, hashes[j : j + n], where=smaller)
        at[smaller] = np.flatnonzero(smaller) + j
    return at[sentence[:n] == sentence[LONG - 1 :]]


def segment(data: np.ndarray, off: np.ndarray):
    """Words and sentences of a slice: word starts, stops, hashes, first word per text, and the first word of every
    sentence with the first sentence of every text (each with one more at the end)."""
    starts, stops, first = K.words(data, off, K.NOT_SPACE)
    hashes = K.word_hashes(data, starts, stops)
    n = len(starts)
    if not n:
        return starts, stops, hashes, first, np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    last = stops - 1
    for _ in range(3):
        move = _CLOSING[data[last]] & (last > starts)
        last = last - move
    ends = _STOP[data[last]]
    ends |= (last - 2 >= starts) & (data[last] == _WIDE_STOP[2]) & (data[last - 1] == _WIDE_STOP[1]) & (data[last - 2] == _WIDE_STOP[0])
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    ends[:-1] |= lines[starts[1:]] > lines[stops[:-1]]
    ends[first[1:][first[1:] > 0] - 1] = True
    ends[_least(hashes, np.concatenate([[0], np.cumsum(ends)[:-1]]))] = True
    begin = np.concatenate([[0], np.flatnonzero(ends) + 1])
    return starts, stops, hashes, first, begin, np.searchsorted(begin, first)


def spans_of(hashes: np.ndarray, first: np.ndarray, begin: np.ndarray, text: np.ndarray, sentences: int, words: int):
    """``(text, sentence, end sentence, hash)`` of the spans of all texts in a slice."""
    n = len(begin) - 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(text) - 1), np.diff(text))
    each = np.arange(n)
    stop = np.maximum(each + sentences, np.searchsorted(begin, begin[:-1] + words))
    start = np.minimum(each + 1 - sentences, np.searchsorted(begin, begin[1:] - words, side="right") - 1)
    down_to = (start >= text[owner]) & (stop[start] != each + 1)
    ok = stop <= text[owner + 1]
    at, stop, owner = np.concatenate([each[ok], start[down_to]]), np.concatenate([stop[ok], each[down_to] + 1]), np.concatenate([owner[ok], owner[down_to]])
    up, down = K._powers(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    lo, hi = begin[at], begin[stop]
    value = K.mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    return owner, at - text[owner], stop - text[owner], value


def _spans(sentences: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in K.slices(batch.column(2)):
                _, _, hashes, first, begin, text = segment(data, off)
                owner, at, stop, value = spans_of(hashes, first, begin, text, sentences, words)
                rows = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array(at.astype(np.int32)), pa.array(stop.astype(np.int32))], ["hash", "doc", "text_hash", "begin", "stop"])

    return run


_SPAN = "hash long, doc {doc}, text_hash long, begin int, stop int"


def _as_before(column: pa.Array) -> np.ndarray:
    """For every value but the first: does it equal the one before it? Null equals null."""
    after, before = column.slice(1), column.slice(0, len(column) - 1)
    both = pc.and_(after.is_null(), before.is_null())
    return pc.or_(pc.fill_null(pc.equal(after, before), False), both).to_numpy(zero_copy_only=False)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted spans those that follow an equal one of another place, as ``repeat``; the first span of the task as ``open``,
    its last as ``end``. Rows of one place, which repeated documents have, are all the first or all a repeat."""
    final, status = None, False

    def tagged(rows: pa.RecordBatch, kind: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([kind] * rows.num_rows, pa.string())], [*rows.schema.names, "kind"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if final is None:
            yield tagged(batch.slice(0, 1), "open")
            final = batch.slice(0, 1)
        # Row 0 is the last row of the batch before.
        columns = [pa.concat_arrays([final.column(j), batch.column(j)]) for j in range(4)]
        run = np.concatenate([[True], ~_as_before(columns[0])])
        moved = np.concatenate([[status], ~np.logical_and.reduce([_as_before(c) for c in columns])])
        places = np.cumsum(moved & ~(run & (np.arange(len(run)) > 0)))
        at = np.maximum.accumulate(np.where(run, np.arange(len(run)), 0))
        again = places > np.where(at > 0, places[at], 0)
        yield tagged(batch.filter(pa.array(again[1:])), "repeat")
        final, status = batch.slice(batch.num_rows - 1, 1), again[-1]
    if final is not None:
        yield tagged(final, "end")


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``(doc, text_hash, begin, stop)``: runs of sentences that repeat an earlier run, stored."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    kind = _SPAN.format(doc=doc_type)
    spans = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text"), "text").mapInArrow(_spans(sentences, words), kind)
    order = ["hash", "doc", "text_hash", "begin"]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = store(spans.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_repeats, f"{kind}, kind string"), "repeats")
    ends = found.filter("kind = 'end'").groupBy("hash").agg(F.min(F.struct("doc", "text_hash", "begin")).alias("earliest"))
    settled = found.filter("kind = 'open'").join(ends, "hash").filter(F.col("earliest") < F.struct("doc", "text_hash", "begin"))
    columns = ["doc", "text_hash", "begin", "stop"]
    return found.filter("kind = 'repeat'").select(*columns).union(settled.select(*columns))


def _cut(names: list[str]):
    """Texts without the sentences of their runs; the runs are the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_text = names.index("text")
        for batch in batches:
            runs = batch.column(batch.num_columns - 1)
            for lo, hi, data, off in K.slices(batch.column(at_text)):
                starts, _, _, _, begin, text = segment(data, off)
                nulls = batch.column(at_text).slice(lo, hi - lo).is_null().to_pylist()
                out, removed = [], []
                for i, cuts in enumerate(runs.slice(lo, hi - lo).to_pylist()):
                    lost = np.zeros(text[i + 1] - text[i], bool)
                    for c in cuts or ():
                        lost[c["begin"] : c["stop"]] = True
                    removed.append(int(lost.sum()))
                    if nulls[i]:
                        out.append(None)
                    elif not removed[-1]:
                        out.append(data[off[i] : off[i + 1]].tobytes())
                    else:
                        edges = starts[begin[text[i] : text[i + 1]]]
                        edges = np.concatenate([edges, off[i + 1 : i + 2]])
                        head = data[off[i] : edges[0]].tobytes()
                        kept = [data[edges[j] : edges[j + 1]].tobytes() for j in np.flatnonzero(~lost)]
                        out.append(head + b"".join(kept) if kept else b"")
                columns = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                columns[at_text] = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(text), pa.int64()), pa.array(removed, pa.int64())], [*names, "n_sentences", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` with ``text`` shortened, and ``n_sentences`` and ``n_removed`` of each text."""
    docs = docs.drop("n_sentences", "n_removed")
    runs = repeated_spans(docs, sentences, words).distinct().groupBy("doc", "text_hash").agg(
        F.collect_list(F.struct("begin", "stop")).alias("_runs"))
    runs = store(runs, "document-runs")
    same = docs["doc_id"].eqNullSafe(runs["doc"]) & (F.xxhash64(docs["text"]) == runs["text_hash"])
    rows = docs.join(runs, same, "left").select(*[docs[c] for c in docs.columns], runs["_runs"])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rows.mapInArrow(_cut(docs.columns), schema)
