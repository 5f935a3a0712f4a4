"""Chat formatting of typed content parts, in DataFrame operations only.

A message has a role and ordered ``parts`` (type, text, uri, width, height, seconds, pages). A visitor expression
turns each part into text: text parts are escaped, an image, audio or document part becomes the placeholder
``<|type:n|>``, where ``n`` counts the attachments of the conversation. Every attachment is recorded with its position,
reference and the number of tokens that its placeholder stands for. A turn is ``<|turn|>role<|says|>text<|end|>``.

Control strings inside texts, of this template and of others (``CONTROLS``), are broken by a backslash behind their first
character, and backslashes are doubled; :func:`unescape` is the exact inverse. So a text can neither end
its turn nor pose as a placeholder.

``formatted`` is one string per conversation, and so are the loss spans of one conversation together: a conversation is
gathered by its key, since its text is one value. Before that, the places of its parts are sums over rows, and nothing in the
gathered row looks back, so time grows with the length of a conversation and not with its square. Spans are counted in code points.

Cases: null text, role and parts are empty; a part of an unknown type is kept as escaped text. Rows with equal turn numbers
are ordered by role and text; repeated rows are repeated turns. A null conversation id is a conversation. No rows
give no conversations. Conversations of any number of turns and texts of any length are formatted whole. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of this and of other templates; fixed values.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]"]
ATTACHMENTS = ["image", "audio", "document"]
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
TILE, TOKENS_PER_TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 512, 170, 25, 512


def escape(text: Column) -> Column:
    """Double backslashes, then break every control string behind its first character."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROLS, doubled)


def unescape(text: Column) -> Column:
    """A backslash behind ``<`` or ``[`` and before the rest of a control string goes; a doubled one becomes single.

    An original backslash is always doubled, so the two cases cannot be taken for each other.
    """
    return F.regexp_replace(text, r"\\(\\)|([<\[])\\(?=[|/sI])", "$1$2")


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment stands for: image tiles, audio seconds or document pages; at least 1."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(TILE)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(TILE)) / TILE)
    count = (
        F.when(part["type"] == "image", tiles * TOKENS_PER_TILE)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * TOKENS_PER_SECOND))
        .otherwise(F.coalesce(part["pages"], F.lit(1)) * TOKENS_PER_PAGE)
    )
    return F.greatest(count.cast("long"), F.lit(1).cast("long"))


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(ATTACHMENTS), F.lit(False))


def text_messages(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` rows as messages of one text part each."""
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), *[
        F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation of ``messages (conv_id, turn, role, parts)``.

    ``formatted``; ``turn_spans`` (``start`` of the turn from 0, ``content`` where its text starts, ``length`` of that, ``loss``);
    ``loss_spans`` (``start``, ``length``) of the content of turns of ``loss_roles``; ``attachments`` (``number, turn_no, type, uri,
    tokens``); ``expanded_tokens``, their sum.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>")
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    shown = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    shown = shown.withColumn("turn_no", F.row_number().over(turns) - 1)
    # A row per part, a turn without parts included, so that running numbers and places are sums over rows.
    rows = shown.select("conv_id", "turn_no", "role", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("pos", "part")).withColumn(
        "pos", F.coalesce("pos", F.lit(0)))
    earlier = Window.partitionBy("conv_id").orderBy("turn_no", "pos").rowsBetween(Window.unboundedPreceding, -1)
    part, opens, closes = F.col("part"), F.col("pos") == 0, F.col("pos") >= F.col("n") - 1
    attached = is_attachment(part)
    rows = rows.withColumn("number", F.coalesce(F.sum(attached.cast("long")).over(earlier), F.lit(0).cast("long")))
    content = F.when(attached, F.concat(F.lit("<|"), part["type"], F.lit(":"), F.col("number").cast("string"), F.lit("|>"))).otherwise(
        escape(F.coalesce(part["text"], F.lit(""))))
    rows = rows.withColumns({"head": F.when(opens, F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))).otherwise(""), "body": content})
    rows = rows.withColumn("piece", F.concat("head", "body", F.when(closes, F.lit(END)).otherwise(""))).select(
        "conv_id", "turn_no", "pos", "number", "role", opens.alias("opens"), closes.alias("closes"), "piece",
        F.coalesce(F.sum(F.length("piece")).over(earlier), F.lit(0).cast("long")).alias("start"),
        F.length("head").alias("head"), F.length("body").alias("body"),
        F.when(attached, F.struct("number", "turn_no", part["type"].alias("type"), part["uri"].alias("uri"), expanded_tokens(part).alias("tokens"))).alias("found"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn_no", "pos", "role", "opens", "closes", "piece", "start", "head", "body", "found"))).alias("m"))
    spans = F.zip_with(F.filter("m", lambda x: x["opens"]), F.filter("m", lambda x: x["closes"]), lambda a, b: F.struct(
        a["start"].alias("start"), (a["start"] + a["head"]).alias("content"),
        (b["start"] + b["head"] + b["body"] - a["start"] - a["head"]).alias("length"), a["role"].isin(list(loss_roles)).alias("loss")))
    loss = F.transform(F.filter("turn_spans", lambda s: s["loss"]), lambda s: F.struct(s["content"].alias("start"), s["length"].alias("length")))
    found = F.transform(F.filter("m", lambda x: x["found"].isNotNull()), lambda x: x["found"])
    chats = chats.select("conv_id", F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("formatted"), spans.alias("turn_spans"), found.alias("attachments"))
    return chats.select("conv_id", "formatted", "turn_spans", loss.alias("loss_spans"), "attachments",
                        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted string; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, SAYS)
        return F.struct(unescape(F.substr(p, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substr(p, at + len(SAYS), F.length(p) - at + 1 - len(SAYS) - len(END))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, turn_spans: Column) -> Column:
    """Unescaped text under the loss mask, in order; the string is cut at its turns once, and each span is read inside its own."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), F.lit(2), F.size(turn_spans))
    return F.array_join(F.zip_with(pieces, turn_spans, lambda p, s: F.when(s["loss"], unescape(
        F.substr(p, (s["content"] - s["start"] - len(TURN) + 1).cast("int"), s["length"].cast("int"))))), "")
