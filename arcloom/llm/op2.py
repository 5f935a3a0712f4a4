"""Query ``op2_substring_dedup``; sentence cuts by hash are not SQL, so tests compare with brute force."""

from __future__ import annotations

from arcloom.llm.registry import query, table
from arcloom.llm.substring_dedup import remove_repeats


@query("op2_substring_dedup")
def op2(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
