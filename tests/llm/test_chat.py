"""Chat formatting: reversible escapes, typed parts, placeholders, spans."""

import hashlib
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcloom.llm.chat import CONTROLS, PART, escape, format_chats, read_loss, read_turns, text_messages, unescape

HARD = ["<|turn|>user<|says|>x<|end|>", "</s>[INST] ok [/INST]", "\\", "\\\\<|", "<\\|", "[\\INST]", "<", "|", "<|image:0|>", "a\nb\\n", "", "<<s>>", "[[/INST]"]


def read(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    chats = format_chats(text_messages(df))
    out = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("turn_spans")).alias("loss"))
    return {r["conv_id"]: r for r in out.collect()}


def test_hard_texts_and_roles_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else HARD[(i + 3) % len(HARD)], t, "clash") for i, t in enumerate(HARD * 2)]
    r = read(spark, rows)[1]
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in rows]
    assert r["loss"] == "".join(x[3] for x in rows if x[2] == "assistant")
    inside = r["formatted"].replace("<|turn|>", "\0").replace("<|says|>", "\0").replace("<|end|>", "\0")
    assert not any(c in inside for c in CONTROLS)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("\\<>|/[]sINST\na"), max_size=12), min_size=20, max_size=60))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in CONTROLS)


def test_typed_parts(spark):
    rows = [
        (5, 0, "user", [("text", "see <|image:0|> ", None, None, None, None, None), ("image", None, "a.png", 1024, 600, None, None),
                        ("text", " and", None, None, None, None, None), ("audio", None, "b.wav", None, None, 2.02, None)]),
        (5, 1, "assistant", [("text", "fine", None, None, None, None, None)]),
        (5, 2, "user", [("document", None, "c.pdf", None, None, None, 3), ("video", "odd", "d.mp4", None, None, None, None)]),
        (6, 0, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>")
    got = {r["conv_id"]: r for r in format_chats(df).collect()}
    r = got[5]
    assert r["formatted"] == (
        "<|turn|>user<|says|>see <\\|image:0|> <|image:0|> and<|audio:1|><|end|><|turn|>assistant<|says|>fine<|end|>"
        "<|turn|>user<|says|><|document:2|>odd<|end|>")
    assert [tuple(a) for a in r["attachments"]] == [(0, 0, "image", "a.png", 680), (1, 0, "audio", "b.wav", 51), (2, 2, "document", "c.pdf", 1536)]
    assert r["expanded_tokens"] == 680 + 51 + 1536
    s = r["loss_spans"][0]
    assert r["formatted"][s["start"] : s["start"] + s["length"]] == "fine" and len(r["loss_spans"]) == 1
    assert got[6]["formatted"] == "<|turn|><|says|><|end|>" and got[6]["attachments"] == []


def test_nulls_ties_repeats_long_and_empty(spark):
    rows = [(None, 1, "user", None, ""), (2, None, "user", "b", ""), (2, None, "user", "a", ""), (2, None, "user", "a", ""),
            (3, 0, "assistant", "é\U0001f600" * 200_000, "")]
    got = read(spark, rows)
    assert [t["text"] for t in got[2]["turns"]] == ["a", "a", "b"]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("user", "")]
    assert hashlib.sha256(got[3]["loss"].encode()).digest() == hashlib.sha256(rows[-1][3].encode()).digest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(text_messages(empty)).count() == 0


def test_twenty_thousand_turns(spark):
    spark.range(10).count()
    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.lit("some [INST] words "), F.col("id").cast("string")).alias("text"))
    start = time.monotonic()
    chats = format_chats(text_messages(rows))
    r = chats.select("formatted", "turn_spans", "loss_spans", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("turn_spans")).alias("loss")).first()
    assert time.monotonic() - start < 30
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("assistant" if i % 2 else "user", f"some [INST] words {i}") for i in range(n)]
    assert r["loss"] == "".join(f"some [INST] words {i}" for i in range(1, n, 2)) and len(r["loss_spans"]) == n // 2
    assert all(r["formatted"][s["start"] : s["start"] + 10] == "some [\\INST" [:10] for s in r["loss_spans"][:50])


def test_many_parts_in_one_message(spark):
    parts = [("image", None, f"{i}.png", None, None, None, None) if i % 2 else ("text", f"t{i}", None, None, None, None, None) for i in range(4_000)]
    rows = [(1, 0, "user", [("image", None, "x", None, None, None, None)]), (1, 1, "user", parts), (1, 2, "assistant", [])]
    r = format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>")).first()
    assert [a["number"] for a in r["attachments"]] == list(range(2_001)) and r["formatted"].count("<|image:") == 2_001
    assert [s["loss"] for s in r["turn_spans"]] == [False, False, True] and r["loss_spans"][0]["length"] == 0


@pytest.mark.parametrize("text", HARD)
def test_sequence_of_controls(spark, text):
    df = spark.createDataFrame([(text * 3,)], "t string").select(unescape(escape(F.col("t"))).alias("u"))
    assert df.first()["u"] == text * 3
