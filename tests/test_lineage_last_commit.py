"""A history whose last commit changes nothing that is known ends without rows."""

from chronofold.operators import lineage


def test_last_commit_without_rows(spark):
    rows = [("r", 1, "c1", "A", "a", "b1"), ("r", 2, "c2", "D", "never", "b2")]
    diffs = spark.createDataFrame(rows, "repository string, seq long, commit string, status string, path string, blob string")
    assert [(r["path"], r["basis"]) for r in lineage.walk(diffs).collect()] == [("a", "introduced")]
