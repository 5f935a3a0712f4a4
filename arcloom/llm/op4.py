"""Query ``op4_minimax_shards``; SQL has no such search, so tests compare with a plain walk over all groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.llm.registry import query, table
from arcloom.llm.sharding import shard_rows


@query("op4_minimax_shards")
def op4(spark, sf_dir):
    rows = shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
