"""Written tables whose rows are dropped, or marked line by line, without a shuffle of the texts.

A table is written once with a row number; rows of one task in runs of ``CHUNK`` numbers are a chunk, and the files are bucketed by chunk.  What is
to go is a set of numbers, gathered to one bitmap a chunk: 64-bit words, bounded by the chunk.  The join of the table with the bitmaps is on the chunk
alone, so Spark reads the written buckets as they lie and moves only the bitmaps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import _WRITTEN, scratch

#: Numbers in a chunk, and bytes of the source that a bucket is meant to hold.
CHUNK_BITS, BUCKET_BYTES, MOST_BUCKETS = 15, 128 << 20, 100_000
CHUNK = 1 << CHUNK_BITS
#: The optimizer gives sources that it cannot measure a size beyond this.
UNKNOWN_BYTES = 1 << 52


def write(df: DataFrame, chunk: str, label: str) -> DataFrame:
    """``df`` written to the shared folder in files bucketed by its column ``chunk``, and read back.

    Buckets only say which file a row is in: their number follows from the optimizer's size of the source, and any number gives the same rows.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < UNKNOWN_BYTES else 0
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), known // BUCKET_BYTES))
    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/{label}-{name}"
    # a task's rows are of few buckets: with a writer for each they need no sort
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")
    try:
        df.write.bucketBy(buckets, chunk).format("parquet").option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(key, before)
    out = spark.table(name)
    out._written_at = path
    _WRITTEN[path] = name
    return out


def bitmaps(gone: DataFrame, chunk: str = "chunk", at: str = "at") -> DataFrame:
    """One row a chunk: chunk_of, words (array of long) with the bits of the numbers ``at`` set; the words end with the last set one."""
    word = F.shiftright(F.col(at), 6)
    words = gone.groupBy(F.col(chunk).alias("chunk_of"), word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(at).bitwiseAND(63).cast("int"))).alias("bits"))
    held = words.groupBy("chunk_of").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"), F.max("word").alias("last"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda w: F.coalesce(F.element_at("held", w), F.lit(0).cast("long")))
    return held.select("chunk_of", dense.alias("words"))


def marked(words: Column, at: Column) -> Column:
    """Whether number ``at`` is set in ``words``; false without words."""
    bits = F.get(words, F.shiftright(at, 6).cast("int"))
    return F.coalesce(F.getbit(bits, at.bitwiseAND(63).cast("int")) == 1, F.lit(False))


def with_words(table: DataFrame, chunk: str, maps: DataFrame) -> tuple[DataFrame, Column]:
    """``table`` (as ``write`` returned it) with a column more, of a new name: the words of each row's chunk, null where it has none."""
    own, words = f"of_{uuid.uuid4().hex}", f"words_{uuid.uuid4().hex}"
    named = maps.select(F.col("chunk_of").alias(own), F.col("words").alias(words)).hint("shuffle_hash")
    return table.join(named, table[chunk] == named[own], "left").drop(own), F.col(words)
