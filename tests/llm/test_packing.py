"""Packing: ids against the tokenizers library, every id in one piece, sequences full and of like cost."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arcloom.llm import packing
from arcloom.llm.op11 import op11
from arcloom.llm.packing import Words, balance, pack, sequences

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def verify(pieces, texts, capacity):
    """``pieces`` are rows of ``pack``; ``texts`` one text per document, ids unique. Returns the fill of each sequence."""
    docs, seqs = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        docs.setdefault(p["doc_id"], []).append((p["start"], ids, p["doc_tokens"]))
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(docs) == set(texts)
    for d, parts in docs.items():
        parts.sort(key=lambda x: x[0])
        assert [x for _, ids, _ in parts for x in ids] == ids_of(texts[d])
        assert [s for s, _, _ in parts] == np.cumsum([0, *(len(i) for _, i, _ in parts)])[:-1].tolist()
        assert {n for _, _, n in parts} == {len(ids_of(texts[d]))}
    fill = {}
    for s, parts in seqs.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
        fill[s] = at
    return fill


def test_words_are_tokenised_as_whole_texts():
    odd = ["á ́b", "ΣΑΣ ΟΔΟΣ", "x\x85y\x1cz　w ", "<|endoftext|>a <|ENDOFTEXT|>", " it's  DON'T", " \x00 a", "İİ ̇", "日本語の 文。" * 30, "a" * 300 + " b", "\x0b\x0c\r\n", "１２ 34 ﬁ"]
    words = Words.of(packing.VOCABULARY)
    for text in odd:
        assert np.frombuffer(words.ids([text.encode().split()])[0], "<u4").tolist() == ids_of(text)[:-1]
    text = ("some words here. " * 200_000).encode()
    assert words.whole(text) == words.ids([text.split()])[0] and len(text) > 3 * packing.BLOCK


@pytest.mark.parametrize("seed", range(6))
def test_balance(seed):
    draw = np.random.Generator(np.random.PCG64(seed))
    lengths = draw.integers(1, 100, 300).tolist()
    count = -(-sum(lengths) // 128)
    out = balance(lengths, count, 128, 1.0, 0.01)
    assert sum(n for _, _, n, _, _ in out) == sum(lengths)
    cost = np.zeros(count)
    for _, _, n, s, _ in out:
        cost[s] += n + 0.01 * n * n
    dealt = np.zeros(count)
    for i, n in enumerate(lengths):
        dealt[i % count] += n + 0.01 * n * n
    assert cost.std() < 0.25 * dealt.std()


def test_query_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fill = verify(pack(docs).collect(), texts, 4096)
    total = sum(fill.values())
    assert len(fill) - 1 <= total / 4096 <= len(fill)
    rows = op11(spark, SF).collect()
    assert sum(r["length"] for r in rows) == total
    for r in rows:
        ids = ids_of(texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]


@pytest.mark.parametrize("capacity,group", [(1, 1), (7, 3), (64, 4)])
def test_small_sequences_and_odd_rows(spark, capacity, group):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two three " * 150), (5, "a"), *[(10 + i, "word " * (i % 9)) for i in range(120)], (900, "x" * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    fill = verify(pack(docs, capacity, group=group).collect(), dict(rows), capacity)
    short = [n for n in fill.values() if n < capacity]
    assert sum(capacity - n for n in short) < capacity * (1 + sum(fill.values()) // (capacity * group))


def test_repeated_rows_clashing_columns_sequences_and_empty(spark):
    rows = [(1, "same text here", 5, 6)] * 40 + [(None, "no id", 5, 6), (None, None, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, offset int").repartition(3)
    pieces = pack(docs, 16)
    got = pieces.collect()
    assert sum(r["length"] for r in got) == 40 * len(ids_of("same text here")) + len(ids_of("no id")) + 1
    whole = sequences(pieces, 16, 9).collect()
    assert all(len(r["ids"]) == 64 for r in whole) and sum(sum(r["lengths"]) for r in whole) == sum(r["length"] for r in got)
    first = {r["sequence_id"]: bytes(r["ids"]) for r in whole}
    assert all(first[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"]) for r in got)
    assert pack(docs.filter(F.lit(False))).count() == 0
