"""The outbox as a state machine in batch form, and the reads that tell how far a projection is.

outbox   outbox_id, event_id, status (pending, leased, delivered, dead_lettered), retry_count, due_at, lease_until, lease, created_at, updated_at, error_class
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.scalars import backoff_ms

# Attempts before a dead letter, delays in milliseconds, the shape of a public error class.
ATTEMPTS, BASE_MS, MOST_MS, LEASE_S = 5, 1000, 300_000, 30
PUBLIC_ERROR, FALLBACK_ERROR = "^[A-Za-z][A-Za-z0-9_.]{0,127}$", "ProjectorError"


def claim(outbox: DataFrame, now: Column, most: int, lease: Column, seconds: int = LEASE_S) -> DataFrame:
    """The first ``most`` rows, by id, that wait and are due or whose lease has run out; leased to ``lease`` from now on.  A cap is the feature here."""
    ready = ((F.col("status") == "pending") & (F.col("due_at") <= now)) | ((F.col("status") == "leased") & (F.col("lease_until") <= now))
    first = outbox.filter(ready).orderBy("outbox_id").limit(most)
    return first.withColumns({"status": F.lit("leased"), "lease": lease, "lease_until": now + F.make_dt_interval(secs=F.lit(seconds))})


def finalize(outbox: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The outbox after results (outbox_id, lease, error): a result counts only under the lease that the row still has.

    No error delivers.  An error makes the row wait for a doubling delay, or a dead letter at the last attempt; its class is kept in public form.
    """
    r = results.select("outbox_id", F.col("lease").alias("_l"), F.col("error").alias("_e"), F.lit(True).alias("_r"))
    held = outbox.join(r, "outbox_id", "left").withColumn("_own", F.coalesce(F.col("_r") & (F.col("status") == "leased") & (F.col("lease") == F.col("_l")), F.lit(False)))
    failed, tries = F.col("_own") & F.col("_e").isNotNull(), F.col("retry_count") + 1
    status = F.when(failed & (tries >= ATTEMPTS), "dead_lettered").when(failed, "pending").when(F.col("_own"), "delivered").otherwise(F.col("status"))
    delay = F.make_dt_interval(secs=(backoff_ms(tries, BASE_MS, MOST_MS) / 1000).cast("decimal(18,6)"))
    return held.withColumns({
        "status": status, "due_at": F.when(failed & (tries < ATTEMPTS), now + delay).otherwise(F.col("due_at")), "retry_count": F.when(failed, tries).otherwise(F.col("retry_count")),
        "error_class": F.when(failed, public_error(F.col("_e"))).otherwise(F.col("error_class")), "lease": F.when(~F.col("_own"), F.col("lease")), "lease_until": F.when(~F.col("_own"), F.col("lease_until")),
    }).drop("_l", "_e", "_r", "_own")


def reopen(outbox: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """Dead letters among ``chosen`` (outbox_id) wait again, with their attempts and error cleared; other rows stay."""
    c = chosen.select("outbox_id", F.lit(True).alias("_c")).distinct()
    again = F.coalesce(F.col("_c") & (F.col("status") == "dead_lettered"), F.lit(False))
    return outbox.join(c, "outbox_id", "left").withColumns({
        "due_at": F.when(again, now).otherwise(F.col("due_at")), "retry_count": F.when(again, 0).otherwise(F.col("retry_count")), "error_class": F.when(~again, F.col("error_class")),
        "status": F.when(again, "pending").otherwise(F.col("status")),
    }).drop("_c")


def public_error(name: Column) -> Column:
    """The class name if it is of the public shape, else with other characters replaced and a letter first, else one fixed name."""
    mended = F.substring(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_.]", "_"), "^[_.0-9]+", ""), 1, 128)
    return F.when(name.rlike(PUBLIC_ERROR), name).when(mended.rlike(PUBLIC_ERROR), mended).otherwise(FALLBACK_ERROR)


def admit(drafts: DataFrame, streams: DataFrame) -> DataFrame:
    """Drafts with ``admitted``: false for those of a quarantined stream (stream_id, status); a stream that is not listed is active."""
    closed = streams.filter("status = 'quarantined'").select("stream_id", F.lit(False).alias("_open")).distinct()
    return drafts.join(closed, "stream_id", "left").withColumn("admitted", F.coalesce("_open", F.lit(True))).drop("_open")


def backlog(outbox: DataFrame, now: Column) -> DataFrame:
    """One row: waiting rows (pending or leased), the age of the oldest in seconds, at least 0, and dead letters."""
    waits = F.col("status").isin("pending", "leased")
    oldest = F.min(F.when(waits, F.col("created_at")))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(oldest.cast("timestamp"))
    return outbox.agg(F.count_if(waits).alias("waiting"), F.coalesce(F.greatest(F.lit(0), F.floor(age / 1_000_000)), F.lit(0)).alias("oldest_age_s"), F.count_if(F.col("status") == "dead_lettered").alias("dead"))


def replay(outbox: DataFrame, events: DataFrame, after: int, delivered_only: bool) -> DataFrame:
    """Events in outbox order above ``after``: delivered ones, or all but dead letters."""
    kept = outbox.filter(F.col("status") == "delivered") if delivered_only else outbox.filter(F.col("status") != "dead_lettered")
    return kept.filter(F.col("outbox_id") > after).select("outbox_id", "event_id").join(events, "event_id")


def replay_conflicts(claims: DataFrame, stored: DataFrame) -> DataFrame:
    """Contents that a replay must refuse before anything is wiped: content_id, reason (conflict: several identities; unreadable: no stored bytes).

    ``claims``: content_id, scope, digest.  ``stored``: digest.
    """
    own = claims.groupBy("content_id").agg(((F.min("scope") != F.max("scope")) | (F.min("digest") != F.max("digest"))).alias("conflict"), F.min("digest").alias("digest"))
    held = own.join(stored.select("digest", F.lit(True).alias("held")).distinct(), "digest", "left")
    return held.select("content_id", F.when(F.col("conflict"), "conflict").when(F.col("held").isNull(), "unreadable").alias("reason")).filter("reason is not null")


def status(checkpoints: DataFrame, outbox: DataFrame, handles: DataFrame) -> DataFrame:
    """Per projector (projector, version, last_outbox_id, state): handled events beyond its checkpoint, dead letters of its types, and the newest error.

    ``outbox`` has event_type; ``handles``: projector, event_type.
    """
    each = outbox.join(F.broadcast(handles), "event_type").join(F.broadcast(checkpoints), "projector")  # a few projectors and types
    beyond = (F.col("outbox_id") > F.col("last_outbox_id")) & (F.col("status") != "dead_lettered")
    out = each.groupBy("projector", "version", "last_outbox_id", "state").agg(
        F.count_if(beyond).alias("lag"), F.count_if(F.col("status") == "dead_lettered").alias("dead"), F.max_by("error_class", F.when(F.col("error_class").isNotNull(), F.struct("updated_at", "outbox_id"))).alias("last_error"),
    )
    return checkpoints.join(out.drop("version", "last_outbox_id", "state"), "projector", "left").fillna(0, ["lag", "dead"])


def checkpoint_faults(checkpoints: DataFrame, outbox: DataFrame) -> DataFrame:
    """Checkpoints whose pointer is wrong (the outbox row of their id has another event, or none) or that missed events.

    ``checkpoints``: projector, last_outbox_id, last_event_id, processed.  ``outbox``: projector, outbox_id, event_id, status, already routed.
    """
    point = checkpoints.select("projector", F.col("last_outbox_id").alias("outbox_id")).join(outbox.select("projector", "outbox_id", F.col("event_id").alias("true_event")), ["projector", "outbox_id"], "left")
    done = outbox.join(F.broadcast(checkpoints.select("projector", "last_outbox_id")), "projector").filter("status = 'delivered' and outbox_id <= last_outbox_id").groupBy("projector").agg(F.count("*").alias("delivered"))
    wide = checkpoints.join(point.select("projector", "true_event"), "projector", "left").join(done, "projector", "left")
    fault = F.when(~F.col("true_event").eqNullSafe(F.col("last_event_id")), "pointer").when(F.coalesce("delivered", F.lit(0)) != F.col("processed"), "missed")
    return wide.withColumn("fault", fault).filter("fault is not null").select("projector", "fault", F.coalesce("delivered", F.lit(0)).alias("delivered"), "processed")


def projection_digest(checkpoints: DataFrame) -> DataFrame:
    """One row: ``pc1-`` and 40 hexadecimal digits over (projector, version, last_outbox_id, state) in order of the projectors, of which there are a few."""
    line = F.concat_ws("|", "projector", "version", F.col("last_outbox_id").cast("string"), "state")
    return checkpoints.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("projector", line.alias("line")))), lambda x: x["line"]), "\n").alias("all")).select(F.concat(F.lit("pc1-"), F.substring(F.sha2("all", 256), 1, 40)).alias("digest"))


def effective_time(window_start: Column, window_end: Column, valid_instant: Column, known_until: Column) -> tuple[Column, Column]:
    """(record time, whether the backlog binds): an open window reads at the later of its start and the valid instant, a closed one a microsecond before its end; never after what is known."""
    at = F.when(window_end.isNull(), F.greatest(window_start, valid_instant)).otherwise(window_end - F.expr("interval 1 microsecond"))
    record = F.least(at, valid_instant)
    binds = F.coalesce(known_until < record, F.lit(False))
    return F.when(binds, known_until).otherwise(record), binds


def history_gate(markers: DataFrame, required: dict[str, str]) -> DataFrame:
    """One row, ``ready``: whether a marker (projector, version) names every required version.  More than 16 markers are no markers."""
    some = [F.count_if((F.col("projector") == p) & (F.col("version") == v)) > 0 for p, v in required.items()]
    ready = F.count("*") <= 16
    for s in some:
        ready = ready & s
    return markers.select("projector", "version").distinct().agg(ready.alias("ready"))


def narrowed(markers: list[DataFrame]) -> DataFrame:
    """The markers (projector, version) that all of the given sets hold."""
    out = markers[0].select("projector", "version").distinct()
    for m in markers[1:]:
        out = out.join(m.select("projector", "version").distinct(), ["projector", "version"], "left_semi")
    return out

