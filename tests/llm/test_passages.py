"""Span removal of passages placed at random, and of odd rows next to whole tables."""

import random

from arcloom.llm.substring_dedup import LONG, remove_repeats
from tests.llm.test_substring_dedup import brute

SF = "/root/testdata/sf0.01"


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r["doc_id"]: (r["text"], r["n_sentences"], r["n_removed"]) for r in remove_repeats(docs).collect()}


def words_of_prose(spark, least):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").dropna().orderBy("doc_id").collect()
    return [w for w in (r["text"].split() for r in rows) if len(w) >= least]


def test_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    passage = " ".join(f"word{i}{'.' if i % 17 == 16 else ''}" for i in range(60))
    far = max(d for d, _ in rows)
    rows += [(far + 1, f"Some start of mine {passage} and an end."), (far + 2, f"plain words {passage} other end"), (far + 3, "w " * 300),
             (far + 4, "the same line of seven words here.\n" * 40), (far + 5, ""), (far + 6, "日本語の文。" * 30), (far + 7, None)]
    got = removed(spark, rows)
    assert {k: v for k, v in got.items() if v[0] is not None} == brute(rows) and got[far + 7] == (None, 0, 0)


def recall(spark, bare):
    """Per passage of 51 to 80 words in two other texts: hit or not, and the share of its words that goes."""
    draw = random.Random(7)
    prose = words_of_prose(spark, 100)
    rows, sizes = [], []
    for i in range(200):
        n = draw.randint(51, 80)
        words = draw.choice(prose)
        at = draw.randrange(len(words) - n + 1)
        mine = [w.strip(".!?") if bare else w for w in words[at : at + n]]
        # Marked words, so that only the copy can repeat them.
        mine = [f"p{i}_{w}" for w in mine]
        sizes.append(n)
        for copy in (0, 1):
            around = [f"s{i}c{copy}{w}" for w in draw.choice(prose)[:80]]
            spot = draw.randrange(len(around))
            rows.append((2 * i + copy, " ".join(around[:spot] + mine + around[spot:])))
    got = removed(spark, rows)
    left = [sum(w.startswith(f"p{i}_") for w in got[2 * i + 1][0].split()) for i in range(200)]
    return [n > rest for n, rest in zip(sizes, left)], [(n - rest) / n for n, rest in zip(sizes, left)], sizes


def test_passages_of_51_to_80_words(spark):
    for bare in (False, True):
        hits, shares, sizes = recall(spark, bare)
        print("bare" if bare else "prose", sum(hits), "of", len(hits), "hit; words removed", round(sum(s * n for s, n in zip(shares, sizes)) / sum(sizes), 3), "least", round(min(shares), 3))
        assert all(hits)
        assert all(s * n > n - 2 * LONG for s, n in zip(shares, sizes))
