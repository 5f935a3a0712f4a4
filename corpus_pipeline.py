"""From documents to token digests: quality rules, near duplicates, repeated passages, benchmark passages, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but the last return the columns
of ``documents``. Stages are written as Parquet in the shared folder and read again, so a lost executor costs at
most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.llm import decontaminate, ngram_join, op10, quality, substring_dedup
from arcloom.sources.workspace import store


#: Near duplicates: words in a shingle, and the least similarity in hundredths.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _packed(docs: DataFrame, *used: str) -> DataFrame:
    """Only the columns that an operator uses, and the others as one, so that no name can clash."""
    rest = [docs[c] for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*rest).alias("_rest") if rest else F.lit(None).alias("_rest"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c) if c in rows.columns and c in ("doc_id", "text", *quality.GROUP) else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no robust outliers of their language and source.

    Null, empty and short texts fail the base rules. Rows are judged each, repeated ones alike, whatever their ids; a null language or
    source is a group. Texts are judged whole. An empty table stays empty.
    """
    rows = store(quality.base_statistics(_packed(docs, "text", *quality.GROUP)), "judged-documents")
    return _unpacked(quality.judge(rows).filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, and of equal ids the one with the smallest text hash.

    Linked are documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more; ``op1`` has its own contract. A
    document is an id, which may be null, with a text, and is known by the 64-bit hash of both: texts that share an id are judged
    each on its own. Rows with equal id and text are one document; the one with the smallest hash of all its columns stays. Null
    ids come last. Null and empty texts are linked with nothing. An empty table stays empty.
    """
    digest = F.xxhash64("text")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", F.xxhash64(F.lit("document"), "doc_id", "text").alias("node"))
    found = ngram_join.ngram_components(rows.select(F.col("node").alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    found = store(found.select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")), "document-groups")
    groups = found.filter("node <> component").select("component").distinct()
    members = found.join(groups, "component", "left_semi").distinct()
    named = rows.select("node", F.struct(F.col("doc_id").isNull(), "doc_id", digest, "node").alias("place")).join(members, "node")
    firsts = named.groupBy("component").agg(F.min("place").alias("first")).select(F.col("first.node").alias("node"))
    gone = store(members.join(firsts, "node", "left_anti").select("node"), "later-documents")
    left = rows.join(gone, "node", "left_anti").select("node", "doc", F.xxhash64("doc").alias("whole"))
    one = left.withColumn("row", F.row_number().over(Window.partitionBy("node").orderBy("whole"))).filter("row = 1")
    return one.select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that repeat earlier ones; a document of nothing else goes.

    Earlier is by id (null first), then text hash; rows with equal id and text are one document. Null and empty texts stay.
    ``n_chars``, if there is one, is counted again. Texts are read whole. An empty table stays empty.
    """
    cut = substring_dedup.remove_repeats(_packed(docs, "doc_id", "text"))
    left = _unpacked(cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_sentences"))), docs)
    size = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return left.withColumns(size)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts stay; rows are judged each. A table without rows, or a benchmark without words, changes nothing.
    """
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, one row per row; a null text has no ids. An empty table gives no rows."""
    return op10.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", encoding),
]

#: Neither the cuts by word hashes nor the encoding are SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
