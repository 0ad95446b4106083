"""Exact deduplication by a heavy-hitter split.

1. One pass hashes every normalised text (A-Z lower-cased, SHA-256) and writes (row, doc_id, digest).
2. Each partition keeps a Misra-Gries summary of ``counters`` digests.  Any digest with more than
   N / counters rows survives in the summary of at least one partition, so the union of the summaries,
   cut to the ``counters`` largest merged counts, holds every truly hot digest.
3. The candidates are *verified*: an exact count and the winning row for each, by a map-side combined
   aggregate.  At most ``counters`` verified winners (about 60 bytes each) are broadcast, and hot rows are
   settled without leaving their partition.
4. All other digests take an ordinary shuffle: each has at most about N / counters rows.

The split decides only where a row is settled, never what is returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import bounded_batches, materialise

COUNTERS = 256


class MisraGries:
    """Frequent items in one pass with ``size`` counters; counts are low by at most N / (size + 1)."""

    def __init__(self, size: int):
        self.size, self.counts = size, {}

    def add(self, item) -> None:
        counts = self.counts
        if item in counts:
            counts[item] += 1
        elif len(counts) < self.size:
            counts[item] = 1
        else:
            self.counts = {k: v - 1 for k, v in counts.items() if v > 1}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        # bytes.lower() changes A-Z only
        digest = [hashlib.sha256((t or b"").lower()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary())], names=["doc_id", "digest"])


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(counters)
        for batch in batches:
            for digest in batch.column(0).to_pylist():
                summary.add(digest)
        if summary.counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(summary.counts), pa.binary()), pa.array(list(summary.counts.values()), pa.int64())],
                names=["digest", "n"],
            )

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, heavy.

    Null or empty texts form one group (the digest of nothing).  The row with the largest doc_id stays; a null
    doc_id counts as smaller than any other; among repeated rows with one doc_id exactly one stays.  keep_id
    is null only where every doc_id of the group is null.  An empty table gives an empty result.  Other input columns are
    not read and may have any name.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(
        source.mapInArrow(_digests, "doc_id long, digest binary").withColumn("row", F.monotonically_increasing_id()), "digests"
    )
    merged = (
        rows.select("digest").mapInArrow(_summaries(counters), "digest binary, n long")
        .groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters)
    )
    winner = F.max(F.struct("doc_id", "row"))
    candidates = F.broadcast(merged.select("digest"))  # at most `counters` rows
    verified = (
        rows.join(candidates, "digest").groupBy("digest").agg(F.count("*").alias("group_size"), winner.alias("w"))
        .filter("group_size > 1")
    )
    heavy = materialise(verified.coalesce(1), "heavy-digests")
    small = F.broadcast(heavy)  # at most `counters` rows
    settled = rows.join(small, "digest").withColumn("heavy", F.lit(True))
    rest = rows.join(small, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count("*").alias("group_size"), winner.alias("w"))
    light = rest.join(groups, "digest").withColumn("heavy", F.lit(False))
    return settled.unionByName(light).select(
        "doc_id",
        F.col("w.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("w.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "heavy",
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
