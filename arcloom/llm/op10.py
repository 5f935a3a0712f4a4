"""Query ``op10_byte_bpe``; SQL has no BPE, so tests compare with the tiktoken library itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.llm.bpe import decode, encode
from arcloom.llm.registry import query, table


def digests(docs):
    coded = decode(encode(docs.select("doc_id", "text")).select("doc_id", "ids"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op10_byte_bpe")
def op10(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
