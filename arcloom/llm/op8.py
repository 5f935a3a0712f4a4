"""Query ``op8_warc_source``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.llm import warc
from arcloom.llm.registry import query, table
from arcloom.sources.workspace import new_path, store

MIN_REVISIT = 1000

SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n < {MIN_REVISIT} OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < {MIN_REVISIT} OR page_id = last THEN NULL ELSE last END AS refers_to
FROM g
"""


def to_records(pages: DataFrame) -> DataFrame:
    """``pages (page_id, url, html)`` as records: of equal payloads from ``MIN_REVISIT`` bytes on, the largest id is the response."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digest = F.sha1(payload)
    lasts = store(pages.select("page_id", digest.alias("_digest"), F.octet_length(payload).alias("_n")).filter(F.col("_n") >= MIN_REVISIT)
                  .groupBy("_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_copies")).filter("_copies > 1"), "payload-groups")
    rows = pages.select("page_id", "url", payload.alias("payload"), digest.alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_length"))
    rows = rows.join(lasts, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_length") >= MIN_REVISIT), "left")
    again = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return rows.select(
        urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(again, urn("_last")).alias("refers_to"), "payload_length", "payload_digest", F.when(~again, F.col("payload")).alias("payload"))


def page_id(urn: str):
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1)


@query("op8_warc_source", SQL)
def op8(spark, sf_dir):
    warc.register(spark)
    folder = new_path(spark, "warc")
    to_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    responses = warc.read(spark, folder).filter("record_type = 'response'").select(
        "record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    revisits = warc.read(spark, folder, payload=False).filter("record_type = 'revisit'").select(
        "record_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits).select(
        F.when(page_id("record_id") != "", page_id("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), page_id("refers_to")).cast("long").alias("refers_to"))
