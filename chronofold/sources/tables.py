"""Readers of the driver's tables, and the ledger and outbox that are derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger: one stream per user, sequences from 1 by (time, id), a recording delay of up to four hours."""
    ev = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(
        "event_id", "user_id", F.concat(F.lit("u"), F.col("user_id")).alias("stream_id"),
        F.row_number().over(order).cast("long").alias("seq"), F.col("ts").alias("occurred_at"),
        (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 5).cast("int"))).alias("observed_at"),
        "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per queued event: every 97th is dead-lettered, the newest 2 % wait, the rest are delivered; every 89th was never queued."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    top = ev.agg(F.max("event_id").alias("top"))
    status = F.when(F.col("event_id") % 97 == 0, "dead_lettered").when(F.col("event_id") * 100 >= F.col("top") * 98, "pending").otherwise("delivered")
    return ev.filter("event_id % 89 <> 0").crossJoin(F.broadcast(top)).select(
        (F.col("event_id") + 1).alias("outbox_id"), "event_id", "event_type", F.col("ts").alias("occurred_at"),
        (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 5).cast("int"))).alias("observed_at"), status.alias("status"),
    )
