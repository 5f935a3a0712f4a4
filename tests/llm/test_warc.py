"""WARC archives: round trips, predicates on headers, payloads that are never decoded, archives without an index."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from arcloom.llm import warc
from arcloom.llm.op8 import op8, to_records

LONG = "<p>payload</p>" * 100


@pytest.fixture
def archive(spark, tmp_path):
    warc.register(spark)
    rows = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, LONG), (4, "http://a/4", "short"), (5, "x\r\ny: z", "short"), (6, "http://a/6", None),
            (7, "http://a/7", ""), (8, "http://a/8", "é\r\n\r\n" * 90_000), (None, "http://a/9", "none"), (4, "http://a/4", "short")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    to_records(pages).write.format("warc").mode("append").save(str(tmp_path / "w"))
    return str(tmp_path / "w"), rows


def expected(rows):
    want = []
    for page, url, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and any(h == html and p is not None and page is not None and p > page for p, _, h in rows)
        want.append((f"<urn:page:{'none' if page is None else page}>", "revisit" if again else "response", len(data), hashlib.sha1(data).hexdigest(),
                     None if again else data, "<urn:page:3>" if again else None))
    return sorted(want, key=str)


@pytest.mark.parametrize("split", [300, 32 << 20])
def test_round_trip(spark, archive, split):
    folder, rows = archive
    got = warc.read(spark, folder, split_bytes=split).collect()
    assert sorted(((r["record_id"], r["record_type"], r["payload_length"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"]),
                    r["refers_to"]) for r in got), key=str) == expected(rows)
    assert {r["target_uri"] for r in got if r["record_id"] == "<urn:page:5>"} == {"x  y: z"}


def test_predicates_and_payload_option(spark, archive):
    folder, _ = archive
    base = lambda: warc.read(spark, folder, payload=False)
    assert base().filter("record_type = 'revisit'").count() == 2
    assert base().filter("payload is not null").count() == 0
    assert {r["record_id"] for r in base().filter(F.col("target_uri").isin("http://a/4", "http://a/7")).collect()} == {"<urn:page:4>", "<urn:page:7>"}
    assert base().filter("record_id = '<urn:page:8>' and record_type = 'response' and payload_length > 10").count() == 1
    assert base().filter("record_id = 'nothing'").count() == 0


def test_unwanted_payloads_are_not_decoded():
    record = dict(record_id="<urn:page:1>", record_type="response", target_uri="u", refers_to=None, payload_length=5_000_000, payload_digest="00" * 20, payload=b"x" * 5_000_000)
    import zlib

    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = z.compress(warc.make_record(record)) + z.flush()
    member = warc.Member(raw)
    assert warc.read_record(member, [("record_type", ("revisit",))], True) is None and len(member.text) <= 2 * warc.HEAD_BYTES
    member = warc.Member(raw)
    assert warc.read_record(member, [], False)[4] == 5_000_000 and len(member.text) <= 2 * warc.HEAD_BYTES
    assert warc.read_record(warc.Member(raw), [], True)[-1] == record["payload"]


def test_without_index_and_without_archives(spark, archive, tmp_path):
    folder, rows = archive
    for f in os.listdir(folder):
        if f.endswith(".cdx"):
            os.rename(f"{folder}/{f}", f"{tmp_path}/{f}")
    got = lambda: warc.read(spark, folder)
    assert got().count() == len(rows) and got().filter("record_type = 'revisit'").count() == 2
    assert got().agg(F.sum(F.octet_length("payload"))).first()[0] == sum(len((h or "").encode()) for p, _, h in rows if p not in (1, 2))
    assert warc.read(spark, str(tmp_path / "missing")).count() == 0


def test_query_and_empty_table(spark, tmp_path):
    warc.register(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    to_records(pages).write.format("warc").mode("append").save(str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
    assert op8(spark, "/root/testdata/sf0.001").columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
