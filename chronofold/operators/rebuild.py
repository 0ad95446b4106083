"""Rebuilt projections: written to a version folder of their own, verified, then published by an atomic pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.secondary import set_digest


class Refused(RuntimeError):
    """A rebuilt version that fails its check, which leaves the published one in place."""


def table_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, whatever the order of its rows; columns in order of their names."""
    cells: list[Column] = []
    for name in sorted(df.columns):
        text = F.to_json(F.struct(F.col(f"`{name}`").alias("v")))  # leaves nulls out, so that they differ from the text 'null'
        cells.append(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    line = F.concat(F.lit(""), *cells)
    row = set_digest(df.withColumn("_line", line).withColumn("_all", F.lit(1)), ["_all"], F.col("_line"), "digest").first()
    return (row["n"], row["digest"]) if row else (0, "")


class Projection:
    """A projected table below ``root`` in a shared folder.  One writer publishes at a time; readers never see a half-written version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        """The published version's name, if there is one."""
        jvm, files = self._files()
        pointer = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_current")
        if not files.util().exists(pointer):
            return None
        stream = files.open(pointer)
        try:
            return bytes(stream.readNBytes(200)).decode()  # a version name
        finally:
            stream.close()

    def read(self) -> DataFrame:
        name = self.version()
        if name is None:
            raise Refused("no version is published")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def stage(self, df: DataFrame) -> str:
        """Write a rebuilt table beside the published one; gives its version name."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def publish(self, name: str, expected: tuple[int, str] | None = None) -> tuple[int, str]:
        """Check the staged version's rows and digest, then swap the pointer in one rename."""
        got = table_digest(self.spark.read.parquet(f"{self.root}/{name}"))
        if expected is not None and got != expected:
            raise Refused(f"staged {got}, expected {expected}")
        jvm, files = self._files()
        new, pointer = (jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}") for n in (f"_next-{name}", "_current"))
        flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE, jvm.org.apache.hadoop.fs.CreateFlag.OVERWRITE)
        stream = files.create(new, flags, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
        try:
            stream.write(name.encode())
        finally:
            stream.close()
        rename = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(new, pointer, rename)
        return got

    def retire(self) -> list[str]:
        """Delete every version but the published one; gives the deleted names.  A version still being staged by another writer would go too."""
        jvm, files = self._files()
        keep, gone = self.version(), []
        for status in files.util().listStatus(jvm.org.apache.hadoop.fs.Path(self.root)):
            name = status.getPath().getName()
            if name.startswith("v-") and name != keep:
                files.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)
