"""Tables are dealt by key once, over parts that grow with the files behind them."""

import os

import pytest

from chronofold.plans import catalog, timeline_queries
from chronofold.sources import scratch
from chronofold.sources.tables import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parts_grow_with_the_files(spark):
    line = table(spark, DATA, "lineitem")
    few = scratch.parts(line)
    assert scratch.parts(line, each=1000) > 10 * few
    assert scratch.parts(line.join(line, "l_orderkey"), each=1000) <= 2 * scratch.parts(line, each=1000)


@pytest.mark.parametrize("name", ["item_currency", "assertion_intervals", "symbol_intervals", "symbol_history", "revision_symbols", "covered_file_intervals", "symbols_as_known", "revision_files"])
def test_timelines_deal_their_facts_once(no_broadcast, name):
    moves = catalog.QUERIES[name](no_broadcast, DATA)
    assert "Exchange hashpartitioning(run" not in plan(moves) and plan(moves).count("Exchange") <= 1


def test_folds_over_buckets_move_nothing(no_broadcast):
    runs, lines, n = timeline_queries._facts(no_broadcast, DATA)
    symbol_items = timeline_queries._symbol_items(runs, lines, n)
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    assert no_broadcast.conf.get(key) == "true"
    no_broadcast.conf.set(key, "false")
    try:
        assert "Exchange" not in plan(timeline_queries._assertion_intervals(runs, lines, n, symbol_items))
    finally:
        no_broadcast.conf.set(key, "true")


def test_one_thing_at_two_runs_between_which_it_is_absent(no_broadcast):
    """Facts are written in buckets; a fold still gives the rows of an interval, a gap and the next interval."""
    from chronofold.operators import timelines as tl

    runs = no_broadcast.createDataFrame([(1, r, r, True) for r in (1, 2, 3)], "scope long, run long, at long, permits boolean")
    seen = no_broadcast.createDataFrame([(1, 1, 7, 5, None), (1, 3, 7, 5, None)], "scope long, run long, file_id long, member long, complete boolean")
    got = sorted((r["run"], r["status"], r["key"]) for r in tl.with_absences(runs, tl.file_items(seen)).collect())
    assert got == [(1, "present", 5), (2, "absent", None), (3, "present", 5)]
