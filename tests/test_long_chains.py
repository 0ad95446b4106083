"""Supersession beyond six and eight links."""

import dataclasses

from chronofold.operators import context, graph
from tests.test_context import T, items, world  # noqa: F401


def test_chain_both_ways(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(12, None), (20, 21), (21, 20), (30, 3)], "id long, next_id long")
    start = spark.createDataFrame([(3,), (20,)], "id long")
    got = {(r["start"], r["id"]): (r["step"], r["truncated"]) for r in graph.chain_both(links, start).collect()}
    want = {(3, k): (k - 3, False) for k in range(13)} | {(3, 30): (-1, False), (20, 20): (0, False), (20, 21): (1, False)}
    assert got == want
    cut = {(r["start"], r["id"]): r["truncated"] for r in graph.chain_both(links, start, 3).collect()}
    assert cut == {(3, k): True for k in (0, 1, 2, 3, 4, 5, 6, 30)} | {(20, 20): False, (20, 21): False}


def test_decision_history_runs_to_the_end(spark, world):  # noqa: F811
    n = 12
    rows = [(f"d{k:02d}", "accepted", "active", ["parse" if k == 0 else "old"], f"d{k + 1:02d}" if k < n else None, None, T[2], [f"e{k}"]) for k in range(n + 1)]
    long = dataclasses.replace(world, decisions=spark.createDataFrame(rows, world.decisions.schema), hits=world.hits.limit(0))
    assert set(items(context.decision_history(long, "parse"))) == {f"decision:d{k:02d}" for k in range(n + 1)}
