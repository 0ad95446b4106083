"""Ledger verification: every digest computed again from its row, ten checks in a fixed order, the first failing one of each stream.

events   stream_id, event_id, sequence, link, producer_id, envelope (canonical text with its producer), envelope_producer, payload, payload_sha256, event_sha256
heads    stream_id, last_sequence, last_event_id, last_event_sha256
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHECKS = ["stream_exists", "sequence", "previous_event_sha256", "event_decode", "producer_id", "payload_sha256", "event_sha256", "stream_head", "stream_head_missing", "event_count"]


def event_digest(link: Column, envelope: Column, payload_digest: Column) -> Column:
    """What an event's digest covers: the previous one, the envelope and the payload's digest, each framed by its length."""
    parts = [F.coalesce(link, F.lit("")), envelope, payload_digest]
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def stream_ids(events: DataFrame, heads: DataFrame) -> DataFrame:
    """Every stream that has a head or an event, so a missing head hides nothing."""
    return heads.select("stream_id").union(events.select("stream_id")).distinct()


def walk(events: DataFrame, canonical: Column, since: int = 1) -> DataFrame:
    """Each stream's first failing event: stream_id, check, at_sequence.  Parallel: links are held against stored digests.

    With ``since`` above 1 the walk starts there; the event before it gives the first link.
    """
    order = Window.partitionBy("stream_id").orderBy("sequence", "event_id")
    rows = events.filter(F.col("sequence") >= since - 1) if since > 1 else events
    rows = rows.withColumns({"before": F.lag("sequence").over(order), "stored_link": F.lag("event_sha256").over(order)})
    expected = F.coalesce(F.col("before") + 1, F.lit(1))
    if since > 1:
        rows = rows.filter(F.col("sequence") >= since)
        expected = F.coalesce(F.col("before") + 1, F.lit(since))
        unlinked = F.col("before").isNull()
    else:
        unlinked = F.lit(False)
    check = F.coalesce(
        F.when((F.col("sequence") != expected) | unlinked, "sequence"), F.when(~F.col("link").eqNullSafe(F.col("stored_link")), "previous_event_sha256"),
        F.when(~F.coalesce(canonical, F.lit(False)), "event_decode"), F.when(~F.col("producer_id").eqNullSafe(F.col("envelope_producer")), "producer_id"),
        F.when(F.col("payload_sha256") != F.sha2("payload", 256), "payload_sha256"), F.when(F.col("event_sha256") != event_digest(F.col("link"), F.col("envelope"), F.col("payload_sha256")), "event_sha256"),
    )
    failed = rows.withColumn("check", check).filter("check is not null")
    return failed.groupBy("stream_id").agg(F.min_by("check", F.struct("sequence", "event_id")).alias("check"), F.min("sequence").alias("at_sequence"))


def verify_ledger(events: DataFrame, heads: DataFrame, canonical: Column, stored_count: int | None = None, asked: DataFrame | None = None, since: int = 1) -> DataFrame:
    """One row for each failing stream (stream_id, check, at_sequence), and one without stream where every stream passes but ``stored_count`` differs.

    ``asked`` (stream_id) limits the walk to some streams; one that has neither head nor event fails ``stream_exists``.
    """
    if asked is not None:
        asked = asked.select("stream_id").distinct()
        events, heads = events.join(asked, "stream_id", "left_semi"), heads.join(asked, "stream_id", "left_semi")
    broken = walk(events, canonical, since)
    last = events.groupBy("stream_id").agg(F.max_by(F.struct("sequence", "event_id", "event_sha256"), F.struct("sequence", "event_id")).alias("e"), F.count("*").alias("n"))
    ids = stream_ids(events, heads)
    if asked is not None:
        ids = ids.union(asked).distinct()
    named = heads.select("stream_id", F.struct("last_sequence", "last_event_id", "last_event_sha256").alias("h"))
    wide = ids.join(broken, "stream_id", "left").join(last, "stream_id", "left").join(named, "stream_id", "left")
    matches = F.col("h.last_sequence").eqNullSafe(F.coalesce("e.sequence", F.lit(0))) & F.col("h.last_event_id").eqNullSafe(F.col("e.event_id")) & F.col("h.last_event_sha256").eqNullSafe(F.col("e.event_sha256"))
    final = F.coalesce(
        F.when(F.col("h").isNull() & F.col("e").isNull(), "stream_exists"), F.col("check"),
        F.when(F.col("h").isNull(), "stream_head_missing"), F.when(~matches, "stream_head"),
    )
    out = wide.select("stream_id", final.alias("check"), F.when(F.col("check").isNotNull(), F.col("at_sequence")).alias("at_sequence")).filter("check is not null")
    if stored_count is None or asked is not None:
        return out
    passed = wide.agg(F.bool_and(final.isNull()).alias("clean"), F.sum("n").alias("walked"))  # one row
    count = passed.filter(F.col("clean") & (F.coalesce("walked", F.lit(0)) != stored_count))
    return out.unionByName(count.select(F.lit(None).cast("string").alias("stream_id"), F.lit("event_count").alias("check"), F.lit(None).cast("long").alias("at_sequence")))
