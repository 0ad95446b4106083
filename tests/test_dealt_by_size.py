"""Steps that sort by file or repository are dealt over parts that follow from the files read; drafts move no digest."""

import os

from pyspark.sql import functions as F

from chronofold.operators import emission
from chronofold.plans import catalog
from chronofold.sources import scratch

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_parts_follow_from_the_files(spark, monkeypatch):
    monkeypatch.setattr(scratch.parts, "__kwdefaults__", {"each": 8000})
    for name, key in (("symbol_validation", "file_id"), ("file_lineage", "repository"), ("draft_submission", "run")):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        dealt = [line for line in plan.splitlines() if "RepartitionByExpression [" + key in line]
        assert dealt and all(int(line.split("], ")[1].split(",")[0]) > 10 for line in dealt), (name, plan)


def test_a_claim_of_any_text_is_compared_whole(spark):
    drafts = spark.createDataFrame([(1, 1, 1, "k1", "aa"), (1, 2, 2, "k2", "bb"), (1, 3, 3, "k3", "cc")], "run long, at long, draft_id long, key string, claim string")
    ledger = spark.createDataFrame([("k1", "aa"), ("k2", "no digest")], "key string, claim string")
    fresh, conflict = emission.submit(drafts, ledger)
    assert [(r["draft_id"], r["batch"], r["claim"]) for r in fresh.collect()] == [(3, 0, "cc")]
    assert [(r["draft_id"], r["claim"]) for r in conflict.collect()] == [(2, "bb")]


def test_the_run_is_dealt_before_the_digest(spark):
    drafts = spark.createDataFrame([(1, 1, 1, "x"), (1, 2, 2, "x"), (2, 3, 3, "x")], "run long, at long, draft_id long, p string")
    keyed = emission.keyed_drafts(drafts, F.col("p"))
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2") < plan.index("RepartitionByExpression")
    assert sorted(r["draft_id"] for r in keyed.collect()) == [1, 3]


def test_code_edges_are_dealt_by_the_files(spark, monkeypatch):
    from chronofold.plans import graph_read_queries

    monkeypatch.setattr(scratch.parts, "__kwdefaults__", {"each": 8000})
    plan = graph_read_queries._edges(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression [" in line]
    assert len(dealt) == 2 and all(int(line.split("], ")[1].split(",")[0]) > 10 for line in dealt)
