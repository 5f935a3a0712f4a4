"""Licence scans against plain Python, and the expression parser."""

import itertools
import re
import time

import pyarrow as pa

from arcloom.llm import licences
from arcloom.llm.licences import BASE_PHRASES, least_identifiers, parse, satisfied, scan_licences
from arcloom.llm.op7 import op7

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), sorted({x for _, x in places})


TEXTS = [
    None, "", "mit", "MIT License", "the mit-license, Apache  License\n2.0 and MIT licenseé", "cc by cc by cc by", "(CC-BY) gnu General PUBLIC license.",
    "word " * 30_000 + "apache license", "É mit license ö apache license", "mit mit license license", "İMIT license",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\nRedistribution and use in source and binary forms",
]


def test_equals_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x")]
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, places, first, last, labels = brute(TEXTS[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, places, first, last, labels), TEXTS[r["doc_id"]]
        assert set(labels) <= set(r["labels"]) and 0 <= r["score"] <= 1
    tagged = next(r for r in got if r["doc_id"] == len(TEXTS) - 1)
    assert tagged["labels"] == ["apache-2.0", "bsd", "classpath-exception-2.0", "gpl-2.0", "mit"] and len(tagged["expressions"]) == 1


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7(spark, sf).collect()
    assert len(got) == len(texts) and any(r["n_base"] for r in got)
    for r in got:
        n, places, first, last, labels = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, places, first, last, ",".join(labels))


def test_empty_table(spark):
    assert scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def ways(expression):
    """Sets of identifiers that satisfy an expression of Python's own grammar, by trying all."""
    names, postfix = parse(expression)
    units = sorted({u.lower() for u in re.findall(r"[\w.-]+ with [\w.-]+|[\w.-]+", expression, re.I)} - {"and", "or"})
    sets = [set(c) for n in range(len(units) + 1) for c in itertools.combinations(units, n)]
    code = re.sub(r"[\w.-]+ with [\w.-]+|[\w.-]+", lambda m: m[0].lower() if m[0].lower() in ("and", "or") else f"({m[0].lower()!r} in held)", expression, flags=re.I)
    for held in sets:
        assert satisfied(postfix, held) == eval(code, {"held": held}), (expression, held)  # noqa: S307
    return min(len(held) for held in sets if satisfied(postfix, held)), least_identifiers(postfix)


def test_expressions():
    for expression in ("MIT", "MIT OR Apache-2.0 AND BSD-3-Clause", "(MIT OR Apache-2.0) AND BSD-3-Clause", "GPL-2.0 with Classpath-exception-2.0 or MIT",
                       "a AND (b OR c AND d) OR (e with f AND g)", "((a))", "a or b or c and d and e"):
        least, bound = ways(expression)
        assert least == bound
    assert ways("a and a or b and c")[0] == 1 and ways("a and a or b and c")[1] == 2
    assert parse("") == ([], []) and parse(") AND MIT") == ([], []) and least_identifiers([]) is None and not satisfied([], {"a"})
    assert parse("MIT AND") == (["mit"], ["mit"]) and parse("MIT AND (") == (["mit"], ["mit"])
    assert parse("(MIT OR")[0] == ["mit"] and parse("MIT Apache")[0] == ["mit"]
    assert parse("a or b and c")[1] == ["a", "b", "c", "AND", "OR"]


def test_large_expressions_and_many_hits():
    factors = " AND ".join(f"(a{i} OR b{i})" for i in range(200))
    deep = "(" * 50_000 + "mit" + ")" * 50_000
    hits = "apache license " * 100_000
    start = time.process_time()
    assert least_identifiers(parse(factors)[1]) == 200 and len(parse(factors)[0]) == 400
    assert parse(deep) == (["mit"], ["mit"])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([hits, "SPDX-License-Identifier: " + factors])], ["doc_id", "text"])
    rows = pa.Table.from_batches(list(licences._scan(iter([batch])))).to_pylist()
    assert rows[0]["n_base"] == 100_000 and (rows[0]["first_word"], rows[0]["last_word"]) == (0, 199_998) and len(rows[1]["labels"]) == 400
    assert time.process_time() - start < 3
