"""Sides that grow with the documents are never built in the driver, whatever the broadcast threshold."""

from __future__ import annotations

import pytest

import corpus_pipeline
from trialforge.llm import mixing, neardup, pii


@pytest.mark.parametrize("stage", [
    lambda s, docs: neardup.near_duplicates(docs),
    lambda s, docs: corpus_pipeline.near_dedup(s, docs, ""),
    lambda s, docs: pii.redacted(docs),
])
def test_no_side_is_broadcast(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    out = stage(spark, docs)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_mixing_meets_its_plan_by_a_merge(spark, sf):
    out = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))
    out.collect()
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
