"""Queries against their SQL, the pipeline against its stages in plain Python, and plans without Python where none is allowed."""

import importlib.util

import pytest

import __spark_entry__ as entry
from arcloom.llm import quality
from arcloom.llm.queries import ORACLES, QUERIES
from arcloom.sources.workspace import store
from tests.llm import test_decontaminate, test_pipeline_near, test_quality, test_substring_dedup
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    message, rows = compare(spark, SF, QUERIES[name], ORACLES[name])
    assert not message and rows


def test_all_are_registered():
    known = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in known) for n in range(1, 14)] == [1] * 13 and "pipeline" in known


def test_native_operators_have_no_python(spark):
    for name in ("op3_robust_outliers", "op4_minimax_shards", "op5_boosted_urls", "op6_typed_chat"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stage_by_stage(spark):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(store(stage(spark, seen[-1], SF), "stage"))
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in seen[:-1]]
    assert all(d.columns == columns for d in seen[:-1])
    # 1: the base rules always hold, and the operator decides the rest.
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(store(quality.base_statistics(docs), "stats")).collect()}
    assert texts[1] == {d: t for d, t in texts[0].items() if verdict[d]}
    assert not any(test_quality.brute(t)[-1] for t in texts[1].values())
    # 2: the smallest id of each group.
    assert texts[2] == {d: texts[1][d] for d in test_pipeline_near.kept(sorted(texts[1].items()))}
    # 3: repeated sentences go.
    cut = test_substring_dedup.brute(sorted(texts[2].items()))
    assert texts[3] == {d: t for d, (t, n, lost) in cut.items() if not lost or lost < n}
    # 4: no benchmark window is left.
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in test_decontaminate.brute(sorted(texts[3].items()), items) if n}
    assert texts[4] == {d: t for d, t in texts[3].items() if d not in hit}
    # 5: one row of digests per document.
    assert {r["doc_id"] for r in seen[5].collect()} == set(texts[4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, seen[5].collect()))


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    prose = " ".join(f"Word{i} and thing{i * 7 % 13} went{i}." for i in range(40))
    rows = [(1, prose, "en", "a", 5, "x"), (1, prose, "en", "a", 5, "x"), (None, prose[:600], "en", None, None, "x"), (2, None, None, None, None, "x"),
            (3, "", "en", "a", 0, "x"), (4, prose + " tail", "en", "a", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    bench = spark.createDataFrame([(1, None), (2, "never seen text " * 5)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for part in (docs, docs.limit(0)):
        now = part
        for name, stage in corpus_pipeline.STAGES:
            now = store(stage(spark, now, str(tmp_path)), "odd")
        ids = [r["doc_id"] for r in now.collect()]
        assert ids.count(1) == (1 if part is docs else 0) and not {2, 3, 4} & set(ids)
