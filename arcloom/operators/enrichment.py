"""Resumable enrichment of a queue of rows by a function that may fail for single rows.

The queue is a folder of Parquet files to which pending rows are appended. A run reads it as a stream of files: every
``files_per_commit`` files are a batch whose results and whose mark of being done are committed together, so a run that was stopped goes on behind
the last commit, and the batch it was in is done again as a whole without leaving half of it behind. Nothing is kept in the driver but the
position in the queue. An error of the function is a result of its row; only an error of the task itself stops the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arcloom.operators.catalogue import capture_errors, dedup_first, pending_rows

ROWS_AT_ONCE = 256
#: Queued files do not get too old to be read.
NEVER = "36500d"
ERROR_FIELDS = [T.StructField("error_type", T.StringType()), T.StructField("error_message", T.StringType())]


def enqueue(pending: DataFrame, folder: str, key: str, order: str, files: int) -> None:
    """Append the rows of ``pending`` whose key is not in the queue yet, dealt over ``files`` files.

    Of rows that share a key the first in ``order`` is queued. A null key is never queued, as its result would have no place.
    """
    spark, path = pending.sparkSession, f"{folder}/queue"
    spark.createDataFrame([], pending.schema).write.mode("append").parquet(path)  # so that there is a queue to read
    queued = spark.read.schema(pending.schema).parquet(path).select(key)
    fresh = dedup_first(pending.filter(F.col(key).isNotNull()).join(queued, key, "left_anti"), key, order)
    fresh.repartition(files, key).write.mode("append").parquet(path)


def _worked(work: Callable[[dict], dict], key: str, schema: T.StructType):
    arrow = to_arrow_schema(schema)
    fields = [f.name for f in schema.fields if f.name not in (key, "error_type", "error_message")]

    def one(row: dict) -> dict:
        try:
            found = work(row)
            return {key: row[key], **{name: found.get(name) for name in fields}}
        except Exception as e:  # noqa: BLE001 - whatever the function raises is the result of this row
            return {key: row[key], "error_type": type(e).__name__, "error_message": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = [one(row) for row in batch.slice(at, ROWS_AT_ONCE).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return run


def enrich(spark: SparkSession, queue_schema: T.StructType, folder: str, key: str, work: Callable[[dict], dict],
           result: T.StructType, files_per_commit: int = 8) -> DataFrame:
    """Run ``work`` on all queued rows without a result and return the results of all runs so far.

    ``work`` takes a row as a dictionary and returns the fields of ``result``; missing ones are null. Returned are the key, those fields,
    ``error_type`` and ``error_message``, which are null where the row did not fail. An empty queue gives no rows.
    """
    schema = T.StructType([queue_schema[key], *result.fields, *ERROR_FIELDS])
    stream = spark.readStream.schema(queue_schema).options(maxFilesPerTrigger=files_per_commit, maxFileAge=NEVER).parquet(f"{folder}/queue")
    run = (
        stream.mapInArrow(_worked(work, key, schema), schema).writeStream.format("parquet")
        .option("path", f"{folder}/results").option("checkpointLocation", f"{folder}/commits").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/results")


def apply_results(songs: DataFrame, results: DataFrame, key: str, stamp: Column, message_chars: int | None = 200,
                  text_chars: int | None = 500) -> DataFrame:
    """Songs with the result fields, stamped where the row was done and with ``extraction_error`` where it failed.

    Of several results for a key a good one wins, then the largest by its fields. All songs that share a key get its result. Songs without a
    result, and those with a null key, stay as they are. What a song was stamped with or failed of before is kept.
    """
    fields = [c for c in results.columns if c not in (key, "error_type", "error_message")]
    marked = capture_errors(results, message_chars, text_chars).select(
        F.col(key).alias("_key"), F.struct(F.col("extraction_error").isNull().alias("good"), *fields, "extraction_error").alias("r"))
    one = marked.groupBy("_key").agg(F.max("r").alias("_r"))
    given = [F.coalesce(f"_r.`{f}`", f).alias(f) if f in songs.columns else F.col(f"_r.`{f}`").alias(f) for f in fields]
    return songs.join(one, songs[key] == one["_key"], "left").select(
        *[c for c in songs.columns if c not in (*fields, "processed_at", "extraction_error")],
        F.coalesce("processed_at", F.when(F.col("_r.good"), stamp)).alias("processed_at"),
        F.coalesce("extraction_error", "_r.extraction_error").alias("extraction_error"), *given)


def enrich_pending(songs: DataFrame, order: str, folder: str, key: str, work: Callable[[dict], dict], result: T.StructType, stamp: Column,
                   files: int = 64, files_per_commit: int = 8) -> DataFrame:
    """The songs after all pending ones have been worked on: done or failed. Called again after a stop, it goes on where it was stopped."""
    todo = pending_rows(songs, order)
    enqueue(todo, folder, key, order, files)
    return apply_results(songs, enrich(songs.sparkSession, todo.schema, folder, key, work, result, files_per_commit), key, stamp)
