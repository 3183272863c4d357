"""Exploded rows are never broadcast by the size that Spark takes them for."""

from __future__ import annotations

from lupafiscal.llm import ngram_join


def test_candidates_are_merged_not_broadcast(spark, settings, tmp_path):
    settings({"spark.sql.autoBroadcastJoinThreshold": "10m"})
    made = spark.range(600).selectExpr("id as c", f"transform(sequence(1, {ngram_join.BANDS}), k -> xxhash64(k, id div 3)) as bands")
    made.write.parquet(str(tmp_path / "classes"))
    edges = ngram_join.candidate_edges(spark.read.parquet(str(tmp_path / "classes")))
    found = {(r.a, r.b) for r in edges.collect()}
    assert found == {(c, c - c % 3) for c in range(600) if c % 3}
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
