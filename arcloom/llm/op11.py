"""Query ``op11_cost_balanced_packing``; SQL has no tokenizer, so tests compare with the tokenizers library and check every sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.llm.packing import pack
from arcloom.llm.registry import query, table


@query("op11_cost_balanced_packing")
def op11(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
