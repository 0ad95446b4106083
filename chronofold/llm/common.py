"""Shared plumbing: the scratch folder, written tables, Arrow batch limits and column rules.

Column rules for every operator in this folder: an operator reads only the columns that its parameters
name, an input column called like one of its result columns is replaced by the result, and all its
intermediate columns live in frames of their own, so extra columns never clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a folder below the warehouse is used and set on a local master; on a cluster, where it would be a folder of one node, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a shared folder for intermediate tables")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(_nullable(df.schema)).parquet(path)
    out._written_at = path
    _WRITTEN[path] = None
    return out


#: The written tables of this process that are still there, by path, with the name of those that the catalog holds.
_WRITTEN: dict[str, str | None] = {}


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``materialise`` or ``chunks.write`` returned, once nothing reads them any more."""
    for df in frames:
        _delete(df.sparkSession, df._written_at)


def _delete(spark: SparkSession, path: str) -> None:
    if name := _WRITTEN.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Sweep:
    """Deletes the tables written since it was made, but those of ``keep``: for a caller that has written its own result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, set(_WRITTEN)

    def __call__(self, *keep: DataFrame) -> None:
        kept = {df._written_at for df in keep}
        for path in [p for p in _WRITTEN if p not in self.before and p not in kept]:
            _delete(self.spark, path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def bounded_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Keep Arrow batches small: texts may be long, and a batch is held whole by a Python worker.

    Frames run after this call returns, so the session keeps the settings; they are only ever lowered, and smaller ones of the caller stay.
    """
    parse = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in (("maxRecordsPerBatch", str(rows)), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < parse(spark.conf.get(key)) <= parse(most):
            spark.conf.set(key, most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns named like result columns (names compare as Spark does, ignoring case)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def append_columns(df: DataFrame, fields: list[T.StructField], compute, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``fields``, which ``compute(texts)`` gives as a list of Python lists.

    ``compute`` is made once per task by calling ``compute()`` and then takes lists of texts, null as ''.
    """
    base = without(df, [f.name for f in fields])
    position = next((i for i, c in enumerate(df.columns) if c.lower() == text_col.lower()), None)
    if position is None:
        raise ValueError(f"no column {text_col}")
    source = df.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(base.columns)], F.col(f"`{df.columns[position]}`").alias("t")
    )
    names = [f"c{i}" for i in range(len(base.columns))]
    types = [pa_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = compute()
        for batch in batches:
            new = each([x or "" for x in batch.column(len(names)).to_pylist()])
            arrays = [batch.column(i) for i in range(len(names))]
            arrays += [pa.array(v, type=t) for v, t in zip(new, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + [f"n{i}" for i in range(len(types))])

    schema = T.StructType(
        [T.StructField(n, f.dataType) for n, f in zip(names, base.schema.fields, strict=True)]
        + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)]
    )
    out = source.mapInArrow(run, schema)
    return out.toDF(*base.columns, *[f.name for f in fields])


def pa_type(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa_type(kind.elementType))
    return simple[kind.simpleString()]
