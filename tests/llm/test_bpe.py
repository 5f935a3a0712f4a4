"""Byte-level BPE against the tiktoken library: short texts, chunked texts, texts that never resynchronise."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from arcloom.llm.bpe import VOCABULARY, decode, encode
from arcloom.llm.op10 import digests


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", None, " ", "a", "don't stop\n\n  now", "é" * 50, "x" * 700, "\t \n " * 90, "12345 " * 60 + "end", "<|endoftext|> [INST] 日本語テキスト " * 20,
    "word, word; WORD   done  " * 40, "\U0001f600‍" * 120, "ab cd" * 33, "ab cd" * 33,
]


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 1 << 11), (64, 16), (40, 40), (10, 1)])
def test_equals_library(spark, library, chunk, overlap):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids2 string")
    rows = decode(encode(docs, chunk=chunk, overlap=overlap)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(TEXTS)))
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r["bytes"]) == text.encode()


def test_query_on_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = digests(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(10, 4), (16, 16), (7, 3), (1 << 15, 1 << 11)])
def test_tokens_of_several_white_spaces(spark, tmp_path, chunk, overlap):
    """A vocabulary in which the pattern's look past white space changes the ids."""
    ranks = {bytes([b]): b for b in range(256)} | {b"\n\n": 256, b"  ": 257, b"\n\n\n": 258, b" a": 259}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" " + str(i).encode() + b"\n" for t, i in ranks.items()))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["a\n\na\n\n\nbb  a   a\n \n" * 40, "abc\n\n" * 60, "\n\n\n\na" * 90, "ab a  " * 77]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, _key string, ids string")
    out = encode(docs, path=str(path), chunk=chunk, overlap=overlap)
    assert sorted(out.columns) == ["_key", "doc_id", "ids", "text"]
    for r in out.collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == own.encode_ordinary(texts[r["doc_id"]])


def test_empty_table_and_bad_overlap(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode(docs).count() == 0
    with pytest.raises(ValueError):
        encode(docs, chunk=10, overlap=11)
