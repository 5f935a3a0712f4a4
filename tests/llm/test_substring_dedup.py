"""Span removal against a plain Python version with dictionaries of word tuples."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arcloom.llm import kernels as K
from arcloom.llm.substring_dedup import LONG, remove_repeats

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def hash_of(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(K.word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def split_words(text):
    out, at = [], 0
    while at < len(text):
        if text[at] in SPACE:
            at += 1
            continue
        stop = at
        while stop < len(text) and text[stop] not in SPACE:
            stop += 1
        out.append((at, stop))
        at = stop
    return out


def sentences_of(text):
    words, groups, now = split_words(text), [], []
    for i, (a, b) in enumerate(words):
        now.append((a, b))
        bare = text[a:b]
        for _ in range(3):
            if len(bare) > 1 and bare[-1] in "\"')]}":
                bare = bare[:-1]
        following = words[i + 1][0] if i + 1 < len(words) else len(text)
        if bare[-1] in ".!?。" or i + 1 == len(words) or "\n" in text[b:following]:
            groups.append(now)
            now = []
    out = []
    for g in groups:
        hashes = [hash_of(text[a:b]) for a, b in g]
        cuts = {max(range(i, i + LONG), key=lambda j: (-hashes[j], j)) for i in range(len(g) - LONG + 1)} | {len(g) - 1}
        lo = 0
        for c in sorted(cuts):
            out.append(g[lo : c + 1])
            lo = c + 1
    return out


def brute(docs, sentences=2, least=16):
    seen, result = {}, {}
    for doc, text in sorted({(d, t) for d, t in docs if t is not None}):
        groups, lost, spans = sentences_of(text), set(), set()

        def enough(i, j):
            return j - i >= sentences and sum(map(len, groups[i:j])) >= least

        for i in range(len(groups)):
            spans |= {(i, j) for j in range(i, min(len(groups), i + least) + 1) if enough(i, j) and not enough(i, j - 1)}
            spans |= {(j, i + 1) for j in range(max(0, i - least), i + 1) if enough(j, i + 1) and not enough(j + 1, i + 1)}
        for i, j in sorted(spans):
            key = tuple(text[a:b].translate(LOWER) for g in groups[i:j] for a, b in g)
            if seen.setdefault(key, (doc, text, i)) != (doc, text, i):
                lost |= set(range(i, j))
        edges = [g[0][0] for g in groups] + [len(text)]
        kept = text[: edges[0]] + "".join(text[edges[i] : edges[i + 1]] for i in range(len(groups)) if i not in lost) if len(lost) < len(groups) or not lost else ""
        result[doc] = (kept, len(groups), len(lost))
    return result


def check(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r["doc_id"]: (r["text"], r["n_sentences"], r["n_removed"]) for r in remove_repeats(docs).collect()}
    want = brute(rows)
    assert {k: v for k, v in got.items() if v[0] is not None} == want
    return got


def test_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = check(spark, rows)
    assert any(v[2] for v in got.values())


def test_passage_in_other_surroundings(spark):
    passage = " ".join(f"word{i}{'.' if i % 17 == 16 else ''}" for i in range(60))
    other = " ".join(f"plain{i}{'.' if i % 9 == 8 else ''}" for i in range(90))
    rows = [(1, f"Some start of mine {passage} and an end."), (2, f"{other} {passage} {other[::-1]}"), (3, f"x{passage}"), (4, other + " tail")]
    got = check(spark, rows)
    assert got[1][2] == 0 and got[2][2] > 0 and got[3][2] > 0 and got[4][2] > 0
    assert "word30" not in got[2][0] and "plain0" in got[2][0]


def test_cases(spark):
    line = "the same line of seven words here.\n"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, line * 40), (5, "short one."), (6, "日本語の文。" * 30), (7, line * 3 + "an end"), (8, "w " * 3000)]
    got = check(spark, rows)
    assert got[1] == (None, 0, 0) and got[2] == ("", 0, 0) and got[3] == (" \n\t", 0, 0)
    assert got[4][2] > 0.9 * got[4][1]


def test_clashing_columns_repeated_rows_and_empty(spark):
    text = "one two three four five six seven eight nine ten. eleven twelve thirteen fourteen fifteen sixteen seventeen."
    docs = spark.createDataFrame([(1, text, 9, "a"), (1, text, 9, "a"), (2, text, 9, "b"), (None, None, 1, "c")],
                                 "doc_id long, text string, n_removed int, hash string")
    out = remove_repeats(docs)
    assert sorted(out.columns) == ["doc_id", "hash", "n_removed", "n_sentences", "text"]
    rows = {(r["doc_id"], r["n_removed"]) for r in out.collect()}
    whole = {r["doc_id"]: r["n_sentences"] for r in out.collect()}
    assert out.count() == 4 and rows == {(1, 0), (2, whole[2]), (None, 0)} and whole[2] > 2
    assert remove_repeats(docs.filter(F.lit(False))).count() == 0


def test_slices_cover_all_rows():
    texts = pa.array(["a" * 700_000, None, "", "b" * 900_000, "c"] * 3)
    seen = [(lo, hi) for lo, hi, _, _ in K.slices(texts)]
    assert seen[0][0] == 0 and seen[-1][1] == 15 and all(a[1] == b[0] for a, b in zip(seen, seen[1:]))
