"""Licence scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates expressions.

A text is normalised to its words, lower-cased for ``A-Z`` and parted by single spaces, where a word is a run of ASCII
letters, digits and non-ASCII bytes; one automaton finds all phrases at word boundaries in one pass. A hit on the tag phrase
sends the parser to the expression behind each ``SPDX-License-Identifier:`` of the text: identifiers, ``AND``, ``OR``,
``WITH`` and parentheses, in that order of strength from loose to tight (``OR``, ``AND``, ``WITH``). The parser gives the
identifiers and the expression in postfix order, from which the number of identifiers that it needs, its weight, and whether a set
of identifiers satisfies it follow in one pass; a broken expression keeps the part before the fault.

``score`` is 0 without a find; each distinct label and each expression brings it closer to 1.

Cases: null is the empty text. Phrases may overlap. Texts, expressions and numbers of hits of any size take time and memory in
proportion to the text. Repeated rows get equal results; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arcloom.llm import kernels as K

#: Phrases and labels of the contract; fixed values.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices that the method knows.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TAG = "spdx license identifier"
TAG_PATTERN = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
STRENGTH = {"OR": 1, "AND": 2, "WITH": 3}


def parse(expression: str) -> tuple[list[str], list[str]]:
    """Identifiers in order, and the expression in postfix order, by the shunting-yard algorithm; both grow with the expression."""
    output: list[str] = []
    waiting: list[str] = []
    names: list[str] = []
    values = 0

    def apply(op: str) -> None:
        nonlocal values
        if values > 1:
            output.append(op)
            values -= 1

    expects_name = True
    for token in TOKEN.findall(expression):
        op = token.upper()
        if expects_name:
            if token == "(":
                waiting.append(token)
            elif token == ")" or op in STRENGTH:
                break
            else:
                names.append(token.lower())
                output.append(token.lower())
                values += 1
                expects_name = False
        elif token == ")":
            while waiting and waiting[-1] != "(":
                apply(waiting.pop())
            if not waiting:
                break
            waiting.pop()
        elif op in STRENGTH:
            while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= STRENGTH[op]:
                apply(waiting.pop())
            waiting.append(op)
            expects_name = True
        else:
            break
    if expects_name and waiting and waiting[-1] != "(":
        waiting.pop()
    for op in reversed(waiting):
        if op != "(":
            apply(op)
    return names, output


def _folded(postfix: list[str], name, steps: dict):
    """The value of a postfix expression, bottom-up; none for an empty one. Identifiers are lower-cased, operators are not."""
    values = []
    for token in postfix:
        if token in STRENGTH:
            right, left = values.pop(), values.pop()
            values.append(steps[token](left, right))
        else:
            values.append(name(token))
    return values[-1] if values else None


def least_identifiers(postfix: list[str]) -> int | None:
    """How many identifiers satisfy the expression: the lesser side of ``OR``, both of ``AND``; ``x WITH y`` is one.

    An identifier that both sides of an ``AND`` need counts twice: finding the true least set would take exponential time.
    """
    return _folded(postfix, lambda _: 1, {"OR": min, "AND": int.__add__, "WITH": lambda a, b: a})


def satisfied(postfix: list[str], allowed) -> bool:
    """Does the expression hold with these identifiers? ``x with y`` is an identifier of its own."""
    def both(a, b):
        return f"{a} with {b}"

    def known(x) -> bool:
        return x if isinstance(x, bool) else x in allowed

    value = _folded(postfix, str, {"OR": lambda a, b: known(a) or known(b), "AND": lambda a, b: known(a) and known(b), "WITH": both})
    return value is not None and known(value)


def _automaton():
    machine = ahocorasick.Automaton()
    for phrase in dict.fromkeys([*BASE_PHRASES, *NOTICES, TAG]):
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


_MACHINE: list = []


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Words of each text, each word with one space before it and the last one with one behind; and their number."""
    starts, _, first = K.words(data, off, K.ALPHANUMERIC)
    word = K.ALPHANUMERIC[data]
    begins = np.zeros(len(data), bool)
    begins[starts] = True
    length = word.astype(np.int64) + begins
    place = np.cumsum(length)
    out = np.full(int(place[-1]) if len(place) else 0, 0x20, np.uint8)
    at = np.flatnonzero(word)
    out[place[at] - 1] = K.LOWER[data[at]]
    edges = np.concatenate([[0], place])[off]
    whole = out.tobytes()
    return [whole[a:b].decode() + " " for a, b in zip(edges[:-1], edges[1:])], np.diff(first)


def scan_text(words: str, text: pa.Scalar) -> tuple:
    """``(n_base, first, last, base labels, labels, expressions, score)`` of a normalised text and its original."""
    base, labels, expressions = set(), set(), []
    n_base, first, last = 0, len(words), -1
    tagged = False
    for end, phrase in _MACHINE[0].iter(words):
        if phrase in BASE_PHRASES:
            start = end - len(phrase)
            n_base, first, last = n_base + 1, min(first, start), max(last, start)
            base.add(BASE_PHRASES[phrase])
        elif phrase in NOTICES:
            labels.add(NOTICES[phrase])
        else:
            tagged = True
    weight = 0.0
    if tagged:
        for found in TAG_PATTERN.findall(text.as_py()):
            names, postfix = parse(found)
            if names:
                labels.update(names)
                expressions.append(found.strip())
                weight += 1.0 / least_identifiers(postfix)
    labels |= base
    score = 1.0 - 0.5 ** (len(labels) + weight)
    # Words are numbered at the first and the last hit only, so many hits cost no more than one.
    ends = [words.count(" ", 0, at) - 1 if n_base else None for at in (first, last)]
    return n_base, *ends, sorted(base), sorted(labels), expressions, score


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expressions array<string>, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _MACHINE:
        _MACHINE.append(_automaton())
    kinds = [pa.int64()] * 3 + [pa.list_(pa.string())] * 3 + [pa.float64()]
    names = [c.split()[0] for c in SCAN.split(", ")]
    for batch in batches:
        texts = batch.column(1)
        for lo, hi, data, off in K.slices(texts):
            words, counts = normalised(data, off)
            rows = [scan_text(w, texts[lo + i]) for i, w in enumerate(words)]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", *names])


def scan_licences(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the finds of every row of ``docs (doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, {SCAN}")
