"""Append, sequence, chain and delivery operators of the event ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators import merge


def session_fold(events: DataFrame) -> DataFrame:
    """Streams folded to sessions: earliest start, furthest status, newest head, smallest value, event count."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type").isin("click", "view"), "output_observed").otherwise("started")
    head = merge.newest_wins(["event_type", "value", "event_id"], ["occurred_at", "event_id"])
    return events.groupBy("stream_id").agg(
        merge.min_non_null("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_at"), merge.advance_status(status, ["occurred_at", "event_id"]).alias("status"),
        head.alias("head"), merge.min_non_null("value").alias("min_value"), F.count("*").alias("n_events"),
    ).select("stream_id", "started_at", "last_at", "status", F.col("head.event_type").alias("head_type"), F.col("head.value").alias("head_value"), F.col("head.event_id").alias("head_id"), "min_value", "n_events")


def classify_append(events: DataFrame, key: list[str], identity: list[str], order: str, batch: Column) -> DataFrame:
    """created / existing / conflict for each draft of a key, and batch_rejected for the innocent rows of a batch with a conflict."""
    w = Window.partitionBy(*key).orderBy(order)
    first = F.first(F.struct(*identity)).over(w)
    own = F.struct(*identity)
    outcome = F.when(F.row_number().over(w) == 1, "created").when(own.eqNullSafe(first), "existing").otherwise("conflict")
    out = events.withColumn("batch", batch).withColumn("outcome", outcome)
    hit = F.max((F.col("outcome") == "conflict").cast("int")).over(Window.partitionBy("batch")) == 1
    return out.withColumn("outcome", F.when(hit & (F.col("outcome") == "created"), "batch_rejected").otherwise(F.col("outcome")))


def stream_heads(events: DataFrame) -> DataFrame:
    head = F.max_by(F.struct("seq", "event_id"), "seq").alias("h")
    return events.groupBy("stream_id").agg(head).select("stream_id", F.col("h.seq").alias("last_seq"), F.col("h.event_id").alias("last_event_id"))


def verify_chain(events: DataFrame) -> DataFrame:
    """The first failing check of each stream with one: sequence before link.  Parallel, because links use stored digests.

    Takes stream_id, seq (the position), stored_seq, stored_link, digest.
    """
    w = Window.partitionBy("stream_id").orderBy("seq")
    wanted_seq = F.coalesce(F.lag("stored_seq").over(w) + 1, F.lit(1))
    bad_link = ~F.col("stored_link").eqNullSafe(F.lag("digest").over(w))
    check = F.when(F.col("stored_seq") != wanted_seq, "sequence").when(bad_link, "link")
    failed = events.withColumn("check", check).filter("check is not null")
    return failed.groupBy("stream_id").agg(F.min_by("check", "seq").alias("first_check"), F.min("seq").alias("at_seq"), F.count("*").alias("n_failed"))


def event_type_stats(events: DataFrame, box: DataFrame) -> DataFrame:
    """Per event type: totals by delivery state; an event without an outbox row is unqueued."""
    joined = events.select("event_id", "event_type").join(box.select("event_id", "outbox_id", "status"), "event_id", "left")
    return joined.groupBy("event_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("outbox_id").isNull()).alias("unqueued"),
        F.count_if(F.col("status") == "delivered").alias("delivered"), F.count_if(F.col("status") == "dead_lettered").alias("dead"),
        F.count_if(F.col("status") == "pending").alias("pending"), F.min("outbox_id").alias("min_outbox"), F.max("outbox_id").alias("max_outbox"),
    )


def freshness(box: DataFrame, recent: int = 1000) -> DataFrame:
    """Completeness watermark, valid instant, known-until and effective record time; one row.

    The watermark is the newest delivered row below the oldest waiting one; dead letters do not hold it.  Known-until is a microsecond before
    the earliest observation that may have been applied beyond the watermark.
    """
    oldest = box.agg(F.min(F.when(F.col("status") == "pending", F.col("outbox_id"))).alias("oldest_waiting"))
    done = box.filter("status = 'delivered'").crossJoin(F.broadcast(oldest)).filter("oldest_waiting is null or outbox_id < oldest_waiting")
    # the newest rows below the oldest waiting one give the watermark, which is the first of them, and the instant
    newest = done.orderBy(F.desc("outbox_id")).limit(recent)
    mark = newest.agg(F.max("outbox_id").alias("watermark"), F.max(F.least("observed_at", "occurred_at")).alias("valid_instant"))
    beyond = box.filter("event_type in ('error', 'purchase')").crossJoin(F.broadcast(mark.select("watermark"))).filter("outbox_id > watermark")
    known = beyond.agg((F.min("observed_at") - F.expr("interval 1 microsecond")).alias("known_until"))
    return oldest.crossJoin(mark).crossJoin(known).select(
        "oldest_waiting", "watermark", "valid_instant", "known_until", F.least("valid_instant", "known_until").alias("effective_at")
    )


def head_mismatch(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Streams whose stored head differs from the computed one, null-safe."""
    s, c = stored.alias("s"), computed.alias("c")
    differs = ~F.col("s.last_seq").eqNullSafe(F.col("c.last_seq")) | ~F.col("s.last_event_id").eqNullSafe(F.col("c.last_event_id"))
    return s.join(c, F.col("s.stream_id") == F.col("c.stream_id"), "left").filter(differs).select(
        F.col("s.stream_id").alias("stream_id"), F.col("s.last_seq").alias("stored_seq"), F.col("c.last_seq").alias("newest_seq")
    )


def orphans(items: DataFrame, sources: str, events: DataFrame) -> DataFrame:
    """Sources of items that no event has, with the number of items that name them."""
    named = items.select(F.explode(sources).alias("source_id"))
    return named.join(events.select(F.col("event_id").alias("source_id")), "source_id", "left_anti").groupBy("source_id").agg(F.count("*").alias("n_items"))
