"""Query ``op7_licence_expressions``; expressions are not SQL, so tests compare with plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.llm.licences import scan_licences
from arcloom.llm.registry import query, table


@query("op7_licence_expressions")
def op7(spark, sf_dir):
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"), "score")
