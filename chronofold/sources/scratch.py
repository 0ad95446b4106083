"""Cutting lineage in the shared folder that the session names, and how many parts a table is dealt over."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of source files behind one part of a table that is dealt by key: what a task sorts or gathers follows from it, not from the input.
PART_BYTES, MOST_PARTS = 2 << 20, 20_000
#: The optimizer gives sources that it cannot measure a size beyond this.
UNKNOWN_BYTES = 1 << 52


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: its plan ends there, and a lost executor costs a read.

    A checkpoint would compute it twice, once to count and once to write, and hide its size from the optimizer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(*frames: DataFrame, each: int = PART_BYTES) -> int:
    """How many parts to deal ``frames`` over, by the size of the files that they read; any number gives the same rows."""
    spark, size = frames[0].sparkSession, 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        size += sum(x for x in sizes if x < UNKNOWN_BYTES)
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return min(MOST_PARTS, max(least, -(-size // each)))


def bucketed(df: DataFrame, key: str, n: int, dealt: bool = False) -> DataFrame:
    """``df`` written once in ``n`` buckets by the hash of ``key`` and read back: joins, groups and windows whose keys begin with it can stay in them.

    ``dealt``: ``df`` is made of such tables, so each task's rows are of one bucket already.
    """
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, key)
    with _in_place(spark):
        rows.write.bucketBy(n, key).format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def folded(df: DataFrame) -> DataFrame:
    """``cut_lineage`` of a plan over tables that are dealt by one key: joins by that key and more use the partitions as they lie."""
    with _in_place(df.sparkSession):
        return cut_lineage(df)


@contextmanager
def _in_place(spark: SparkSession) -> Iterator[None]:
    """By default Spark deals both sides of a join again by all its keys; the other setting holds for one write only."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a folder below the warehouse on a local master, and an error on a cluster."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset: a cluster needs a shared folder")
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        context.setCheckpointDir(root)
    return context.getCheckpointDir().rstrip("/")
