"""Fill-in-the-middle by a learned rank index over token boundaries.

A *unit* is white space with the word after it, or white space at the end of the text; boundary ``r`` is the place, in code
points, after the first ``r`` units. ``rank_index`` fits all boundaries of a text by straight pieces: a piece runs through its
two end points, and is halved until no boundary of it is further than ``error`` from the line, so there are few pieces where
units are of similar length. What a boundary differs from the floor of its line is kept in a signed byte. ``cut_at``
predicts a boundary from its rank and adds that residual, which gives the exact place without reading the text again; an index
stored once serves any number of epochs with other seeds. All of it is integer arithmetic, so no rounding can move a cut.

``fill_in_middle`` draws two ranks per document from a hash of seed and id, cuts there, and writes the three parts in the order
of the drawn form; ``restore`` rebuilds the text from output and form alone.

Cases: a null text is empty, has the index of one boundary and stays plain, as does a text that holds a marker. A null
``doc_id`` is drawn as an empty string. Rows are independent: repeated rows and ties get the same result each. Texts of any length
are indexed whole, a byte per unit; a run without white space is one unit and one piece. An empty table gives no rows. All
input columns stay; columns of the names that an operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcloom.llm import kernels as K

SEED = 42
ERROR = 127
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT = 50, 80
INDEX = "struct<n: long, ranks: array<long>, places: array<long>, residuals: binary>"


def boundaries(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of all texts of a slice in code points, each text from 0 on, and the first one of every text."""
    _, stops, first = K.words(data, off, K.NOT_SPACE)
    n = np.diff(first)
    last = np.full(len(n), -1)
    last[n > 0] = stops[first[1:][n > 0] - 1]
    tail = (np.diff(off) > 0) & (last != off[1:])
    counts = 1 + n + tail
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.empty(begin[-1], np.int64)
    at[begin[:-1]] = off[:-1]
    at[begin[1:][tail] - 1] = off[1:][tail]
    at[np.arange(len(stops)) + np.repeat(begin[:-1] + 1 - first[:-1], n)] = stops
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    places = points[at]
    return places - np.repeat(points[off[:-1]], counts), begin


def fit(places: np.ndarray, begin: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ends of all texts, as places in ``places``, and the residual of every boundary.

    All pieces of all texts are tried together; those with too large an error are halved. A piece of two boundaries has none.
    """
    residuals = np.zeros(len(places), np.int64)
    lo, hi = begin[:-1], begin[1:] - 1
    ends = [lo, hi]
    while len(lo):
        size = hi - lo + 1
        at = np.concatenate([[0], np.cumsum(size)])
        step = np.arange(at[-1]) - np.repeat(at[:-1], size)
        each = step + np.repeat(lo, size)
        rise, run = places[hi] - places[lo], np.maximum(hi - lo, 1)
        off = places[each] - (np.repeat(places[lo], size) + step * np.repeat(rise, size) // np.repeat(run, size))
        residuals[each] = off
        bad = np.maximum.reduceat(np.abs(off), at[:-1]) > error
        lo, hi = lo[bad], hi[bad]
        half = (lo + hi) // 2
        ends.append(half)
        lo, hi = np.concatenate([lo, half]), np.concatenate([half, hi])
    return np.unique(np.concatenate(ends)), residuals


def _indexed(names: list[str], error: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in K.slices(batch.column("text")):
                places, begin = boundaries(data, off)
                ends, residuals = fit(places, begin, error)
                count = np.diff(begin)
                pieces = np.searchsorted(ends, begin)
                rank = ends - np.repeat(begin[:-1], np.diff(pieces))
                packed, edges = residuals.astype(np.int8).tobytes(), begin.tolist()
                index = pa.StructArray.from_arrays(
                    [pa.array(count - 1), K.row_lists(pa.array(rank), np.diff(pieces)), K.row_lists(pa.array(places[ends]), np.diff(pieces)),
                     K.binary_rows([packed[a:b] for a, b in zip(edges, edges[1:])])], ["n", "ranks", "places", "residuals"])
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, index], [*names, "index"])

    return run


def rank_index(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """``docs`` with ``index``: number of units, ends of the pieces as ranks and places, and a residual for every rank."""
    if not 0 <= error <= 127:
        raise ValueError("a residual has to fit into a signed byte")
    docs = docs.drop("index")
    kind = T.StructType([*docs.schema.fields, T.StructField("index", T._parse_datatype_string(INDEX))])
    return docs.mapInArrow(_indexed(docs.columns, error), kind)


def cut_at(index: Column, rank: Column) -> Column:
    """The boundary of a rank in code points: the line of its piece plus the stored residual."""
    ranks, places = index["ranks"], index["places"]
    # Piece ends are in order, so the piece of a rank starts at the last one up to it; the last end belongs to the piece before.
    piece = F.greatest(F.least(F.size(F.filter(ranks, lambda r: r <= rank)), F.size(ranks) - 1), F.lit(1))
    low, start = F.element_at(ranks, piece), F.element_at(places, piece)
    run = F.coalesce(F.try_element_at(ranks, piece + 1) - low, F.lit(1))
    rise = F.coalesce(F.try_element_at(places, piece + 1) - start, F.lit(0))
    byte = F.conv(F.hex(F.substring(index["residuals"], (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return start + F.call_function("div", (rank - low) * rise, run) + byte - F.when(byte > 127, 256).otherwise(0)


def draws(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``_draws``, four 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return docs.withColumn("_draws", F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]))


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with ``n`` units, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    Where ``docs`` come with the ``index`` of ``rank_index``, that one is used.
    """
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "output", "_draws")
    rows = draws(docs, seed) if "index" in docs.columns else rank_index(draws(docs, seed))
    text, index, drawn = F.coalesce("text", F.lit("")), F.col("index"), F.col("_draws")
    ranks = [drawn[i] % (index["n"] + 1) for i in (0, 1)]
    plain = (F.length(text) == 0) | (drawn[2] % 100 >= fim_percent)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(marker))
    rows = rows.withColumn("form", F.when(plain, "plain").when(drawn[3] % 100 < spm_percent, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    first, second = cut_at(index, F.least(*ranks)), cut_at(index, F.greatest(*ranks))
    rows = rows.withColumns({"n": index["n"], "prefix_chars": F.when(cut, first), "middle_chars": F.when(cut, second - first)})
    head, inner = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substring(text, F.lit(1), head), F.substring(text, head + 1, inner)
    suffix = F.substring(text, head + inner + 1, F.length(text))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(
        F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(text)
    return rows.withColumn("output", output).drop("_draws", "index")


def restore(output: Column, form: Column) -> Column:
    """The text again. A marker cannot arise where parts meet, since each begins with ``<`` and ends with ``>``."""
    first = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    opened = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    at, stop = F.instr(opened, first), F.instr(opened, F.lit(MIDDLE))
    before = F.substring(opened, F.lit(1), at - 1)
    between = F.substring(opened, at + 3, stop - at - 3)
    middle = F.substring(opened, stop + 3, F.length(opened))
    return F.when(form == "psm", F.concat(before, middle, between)).when(form == "spm", F.concat(between, middle, before)).otherwise(output)
