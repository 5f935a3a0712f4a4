"""Query ``op5_boosted_urls``; SQL has no trees, so tests check rules by brute force and the trees by held-out accuracy."""

from __future__ import annotations

from arcloom.llm.registry import query, table
from arcloom.llm.urls import judge_urls


@query("op5_boosted_urls")
def op5(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
