"""Points find their innermost span with files dealt once on each side."""

from chronofold.operators import emission


def test_files_are_dealt_once(spark):
    spans = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 10, 50), (1, 3, 20, 30), (1, 4, 10, 50), (2, 5, 0, 5)], "file_id long, symbol_id long, start long, end long")
    points = spark.createDataFrame([(1, 1, 22, 24), (2, 1, 12, 14), (3, 1, 90, 101), (4, 1, 22, 24), (5, 3, 1, 2), (6, 1, 60, 61), (7, 1, None, 3)], "ref_id long, file_id long, start long, end long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = emission.innermost(points, spans)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 2
        assert {r["ref_id"]: r["enclosing"] for r in out.collect()} == {1: 3, 2: 2, 3: None, 4: 3, 5: None, 6: 1, 7: None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
