"""Files that lie in one split are parsed by many tasks."""

from chronofold.functions.structure import structure


def test_one_split_is_dealt_over_tasks(spark, tmp_path):
    spark.range(400).selectExpr("concat('p', id) AS path", "concat('x = ', id) AS source").coalesce(1).write.parquet(str(tmp_path / "files"))
    out = structure(spark.read.parquet(str(tmp_path / "files")))
    assert out.rdd.getNumPartitions() >= 4
    assert out.filter("kind = 'variable'").count() == 400
