"""The _all walks take every edge: cycles and loops."""

from chronofold.operators import graph
from chronofold.plans import catalog, retrieval_queries


def test_paths_over_cycles_and_loops(spark):
    edges = spark.createDataFrame([(3, 3), (3, 1), (1, 3), (1, 20), (3, 20), (20, 3), (20, 20)], "src long, dst long")
    assert {r["path"] for r in graph.simple_paths(edges, 3, 20, 4).collect()} == {"3>20", "3>1>20"}


def test_all_edges_reach_lower_keys(spark):
    d = "/root/testdata/sf0.001"
    assert retrieval_queries._trade_all(spark, d).filter("dst < src").count() > 0
    ids = {r["id"] for r in catalog.QUERIES["graph_callees_all"](spark, d).collect()}
    assert min(ids) < 3 and "c_nationkey >" not in catalog.ORACLE_SQL["graph_callees_all"]
    assert catalog.QUERIES["graph_paths_all"](spark, d).count() > catalog.QUERIES["graph_paths"](spark, d).count()
