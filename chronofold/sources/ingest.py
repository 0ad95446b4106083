"""Batch ingestion from JSON lines: schema gate, size limit, whole-batch rules, and a reason for every rejected row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "batch_id long, producer_id string, idempotency_key string, event_type string, value double, _corrupt string"
TYPES = ["signup", "error", "click", "view", "purchase"]


def gate(raw: DataFrame, column: str = "body", max_bytes: int = 4096, types: list[str] = TYPES) -> DataFrame:
    """The parsed columns of each line and its outcome.

    too_large, malformed and unknown_type concern one row; a key that occurs twice in a batch rejects the batch (duplicate_key
    for the offenders, batch_rejected for its other sound rows).  Oversized bodies are not parsed.
    """
    small = F.octet_length(column) <= max_bytes
    parsed = raw.withColumn("e", F.from_json(F.when(small, F.col(column)), SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    missing = F.col("e.batch_id").isNull() | F.col("e.producer_id").isNull() | F.col("e.idempotency_key").isNull()
    reason = F.when(~small, "too_large").when(F.col("e._corrupt").isNotNull() | F.col("e").isNull() | missing, "malformed").when(~F.col("e.event_type").isin(types), "unknown_type")
    rows = parsed.withColumn("reason", reason).select(*raw.columns, "e.batch_id", "e.producer_id", "e.idempotency_key", "e.event_type", "e.value", "reason")
    sound = F.col("reason").isNull()
    # rows without a batch are dealt by their own reason; they never join a batch rule
    key = Window.partitionBy("batch_id", "producer_id", "idempotency_key")
    rows = rows.withColumn("twice", sound & (F.sum(sound.cast("int")).over(key) > 1))
    spoilt = F.max(F.col("twice")).over(Window.partitionBy("batch_id"))
    return rows.withColumn("reason", F.when(F.col("twice"), "duplicate_key").when(sound & spoilt, "batch_rejected").otherwise(F.col("reason"))).drop("twice")
