"""The session fold as a stream: partial folds per micro-batch, appended idempotently, merged on read.

Every rule of the fold is commutative, associative and idempotent over partial states, so partial rows may arrive in any
order, and a replayed batch overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events in one file of the stream, which is one micro-batch; a short stream still has several.
FILE_EVENTS, LEAST_FILES = 1_000_000, 4


def partial(events: DataFrame) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type").isin("click", "view"), 1).otherwise(0)
    return events.groupBy("stream_id").agg(
        F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_at"), F.max(rank).alias("rank"),
        F.max(F.struct("occurred_at", "event_id", "event_type", "value")).alias("head"), F.min("value").alias("min_value"), F.count("*").alias("n_events"),
    )


def merged(states: DataFrame) -> DataFrame:
    label = F.when(F.max("rank") == 2, "completed").when(F.max("rank") == 1, "output_observed").otherwise("started")
    out = states.groupBy("stream_id").agg(
        F.min("started_at").alias("started_at"), F.max("last_at").alias("last_at"), label.alias("status"), F.max("head").alias("head"), F.min("min_value").alias("min_value"), F.sum("n_events").alias("n_events"),
    )
    return out.select("stream_id", "started_at", "last_at", "status", F.col("head.event_type").alias("head_type"), F.col("head.value").alias("head_value"), F.col("head.event_id").alias("head_id"), "min_value", "n_events")


def fold_stream(events: DataFrame, folder: str) -> DataFrame:
    """Write ``events`` as a file stream, fold it one file a micro-batch, and return the merged table."""
    spark = events.sparkSession
    files = max(LEAST_FILES, -(-events.count() // FILE_EVENTS))
    events.repartition(files, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def save(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return merged(spark.read.parquet(f"{folder}/state"))
