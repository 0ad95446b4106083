"""Delivery, replay and projection state over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import delivery, folds
from chronofold.plans.fold_queries import HANDLES
from chronofold.plans.ledger_queries import BOX
from chronofold.sources.tables import ledger, outbox, table

NOW = "2024-01-29 00:00:00"
ERRORS = ["ValueError", "_Private", "Größe", "9.Bad Name", "日本"]


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _box(spark, d):
    """The outbox with leases: every third waiting row is leased, half of them run out; retries from the event's number."""
    b = outbox(spark, d)
    e = F.col("event_id")
    leased = (F.col("status") == "pending") & (e % 3 == 0)
    return b.select(
        "outbox_id", "event_id", "event_type", F.when(leased, "leased").otherwise(F.col("status")).alias("status"), (e % 6).alias("retry_count"), (F.col("occurred_at") + F.make_dt_interval(hours=(e % 30).cast("int"))).alias("due_at"),
        F.when(leased, _now() + F.make_dt_interval(mins=(e % 7 - 3).cast("int"))).alias("lease_until"), F.when(leased, F.concat(F.lit("w"), (e % 4).cast("string"))).alias("lease"), F.col("occurred_at").alias("created_at"), F.col("observed_at").alias("updated_at"),
        F.when(e % 97 == 0, F.array(*[F.lit(x) for x in ERRORS])[(e % 5).cast("int")]).alias("error_class"),
    )


DBOX = f"""{BOX}, db AS (SELECT outbox_id, event_id, event_type, CASE WHEN status = 'pending' AND event_id % 3 = 0 THEN 'leased' ELSE status END AS status, event_id % 6 AS retry_count, occurred_at + to_hours(event_id % 30) AS due_at,
  CASE WHEN status = 'pending' AND event_id % 3 = 0 THEN TIMESTAMP '{NOW}' + to_minutes(event_id % 7 - 3) END AS lease_until, CASE WHEN status = 'pending' AND event_id % 3 = 0 THEN 'w' || (event_id % 4) END AS lease,
  occurred_at AS created_at, observed_at AS updated_at, CASE WHEN event_id % 97 = 0 THEN {ERRORS!r}[event_id % 5 + 1] END AS error_class FROM box)"""
READY = f"(status = 'pending' AND due_at <= TIMESTAMP '{NOW}') OR (status = 'leased' AND lease_until <= TIMESTAMP '{NOW}')"


def outbox_claim(spark, d):
    return delivery.claim(_box(spark, d), _now(), 50, F.lit("me")).select("outbox_id", "event_id", "status", "lease", "lease_until")


CLAIM_SQL = f"WITH {DBOX} SELECT outbox_id, event_id, 'leased' AS status, 'me' AS lease, TIMESTAMP '{NOW}' + INTERVAL 30 SECOND AS lease_until FROM db WHERE {READY} ORDER BY outbox_id LIMIT 50"


def outbox_finalize(spark, d):
    """Workers report on every leased row, half of them under a lease that they have lost; every third report is an error."""
    b = _box(spark, d)
    e = F.col("event_id")
    results = b.filter("status = 'leased'").select("outbox_id", F.when(e % 2 == 0, F.col("lease")).otherwise("lost").alias("lease"), F.when(e % 9 != 0, F.array(*[F.lit(x) for x in ERRORS])[(e % 5).cast("int")]).alias("error"))
    out = delivery.finalize(b, results, _now())
    return out.select("outbox_id", "status", "retry_count", "due_at", "lease", "error_class")


MENDED = {"ValueError": "ValueError", "_Private": "Private", "Größe": "Gr__e", "9.Bad Name": "Bad_Name", "日本": delivery.FALLBACK_ERROR}
FINALIZE_SQL = f"""WITH {DBOX}, x AS (SELECT *, status = 'leased' AND event_id % 2 = 0 AS own, CASE WHEN event_id % 9 <> 0 THEN {ERRORS!r}[event_id % 5 + 1] END AS err FROM db), y AS (SELECT *, own AND err IS NOT NULL AS failed, retry_count + 1 AS tries FROM x)
SELECT outbox_id, CASE WHEN failed AND tries >= 5 THEN 'dead_lettered' WHEN failed THEN 'pending' WHEN own THEN 'delivered' ELSE status END AS status, CASE WHEN failed THEN tries ELSE retry_count END AS retry_count,
  CASE WHEN failed AND tries < 5 THEN TIMESTAMP '{NOW}' + to_milliseconds(CAST(least(300000, 1000 * pow(2, tries - 1)) AS BIGINT)) ELSE due_at END AS due_at, CASE WHEN NOT own THEN lease END AS lease,
  CASE WHEN failed THEN {list(MENDED.values())!r}[event_id % 5 + 1] ELSE error_class END AS error_class FROM y"""


def outbox_reopen(spark, d):
    b = _box(spark, d)
    return delivery.reopen(b, b.filter("event_id % 194 = 0").select("outbox_id"), _now()).filter("event_id % 97 = 0").select("outbox_id", "status", "retry_count", "due_at", "error_class")


REOPEN_SQL = f"""WITH {DBOX} SELECT outbox_id, CASE WHEN event_id % 194 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN event_id % 194 = 0 THEN 0 ELSE retry_count END AS retry_count,
  CASE WHEN event_id % 194 = 0 THEN TIMESTAMP '{NOW}' ELSE due_at END AS due_at, CASE WHEN event_id % 194 <> 0 THEN error_class END AS error_class FROM db WHERE event_id % 97 = 0"""


def stream_quarantine(spark, d):
    ev = ledger(spark, d)
    streams = ev.filter("event_type = 'error' and k % 50 = 0").select("stream_id", F.lit("quarantined").alias("status"))
    return delivery.admit(ev.select("event_id", "stream_id"), streams)


QUARANTINE_SQL = "SELECT event_id, 'u' || user_id AS stream_id, user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 = 0) AS admitted FROM events"


def outbox_backlog(spark, d):
    return delivery.backlog(_box(spark, d), _now())


BACKLOG_SQL = f"""WITH {DBOX} SELECT count(*) FILTER (status IN ('pending', 'leased')) AS waiting, coalesce(greatest(0, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(min(created_at) FILTER (status IN ('pending', 'leased')))) / 1000000.0)::BIGINT), 0) AS oldest_age_s,
  count(*) FILTER (status = 'dead_lettered') AS dead FROM db"""


def ledger_replay(spark, d):
    """What a rebuild reads after outbox row 100: delivered events, and how many more the catch-up takes."""
    b, ev = _box(spark, d), table(spark, d, "events").select("event_id", "event_type", "value")
    done = delivery.replay(b.drop("event_type"), ev, 100, True).withColumn("phase", F.lit("replay"))
    rest = delivery.replay(b.drop("event_type").filter("status <> 'delivered'"), ev, 100, False).withColumn("phase", F.lit("catch_up"))
    return done.unionByName(rest).select("outbox_id", "event_id", "event_type", "value", "phase")


REPLAY_SQL = f"""WITH {DBOX} SELECT outbox_id, event_id, e.event_type, value, CASE WHEN status = 'delivered' THEN 'replay' ELSE 'catch_up' END AS phase FROM db JOIN events e USING (event_id) WHERE outbox_id > 100 AND status <> 'dead_lettered'"""


def replay_precheck(spark, d):
    """Four documents claim one content; they conflict where their sources differ, and are unreadable where the smallest digest is not stored."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("content_id"), F.col("lang").alias("scope"), F.sha2(F.coalesce("source", F.lit("")), 256).alias("digest"), "doc_id")
    return delivery.replay_conflicts(docs, docs.filter("doc_id % 5 = 0").select("digest").filter(F.substring("digest", 1, 1) < "8"))


PRECHECK_SQL = """WITH c AS (SELECT doc_id // 4 AS content_id, lang AS scope, sha256(coalesce(source, '')) AS digest, doc_id FROM documents), h AS (SELECT DISTINCT digest FROM c WHERE doc_id % 5 = 0 AND digest[1:1] < '8'),
o AS (SELECT content_id, min(scope) <> max(scope) OR min(digest) <> max(digest) AS conflict, min(digest) AS digest FROM c GROUP BY 1)
SELECT * FROM (SELECT content_id, CASE WHEN conflict THEN 'conflict' WHEN digest NOT IN (SELECT digest FROM h) THEN 'unreadable' END AS reason FROM o) WHERE reason IS NOT NULL"""


def _handles(spark):
    return spark.createDataFrame([(p, t) for p, types in HANDLES.items() for t in types], "projector string, event_type string")


def _checkpoints(spark, d):
    """A checkpoint for each projector: the newest delivered row of its types below 90 % of the ledger; one has a wrong pointer, one a wrong count."""
    routed = folds.routed(_box(spark, d), HANDLES)
    top = table(spark, d, "events").agg((F.max("event_id") * 9 / 10).alias("top"))
    done = routed.filter("status = 'delivered'").crossJoin(F.broadcast(top)).filter("outbox_id <= top")  # one row
    own = done.groupBy("projector").agg(F.max("outbox_id").alias("last_outbox_id"), F.max_by("event_id", "outbox_id").alias("last_event_id"), F.count("*").alias("processed"))
    return own.select(
        "projector", F.lit("1").alias("version"), "last_outbox_id", F.when(F.col("projector") == "agent", F.col("last_event_id") + 1).otherwise(F.col("last_event_id")).alias("last_event_id"),
        F.when(F.col("projector") == "search", F.col("processed") - 2).otherwise(F.col("processed")).alias("processed"), F.lit("running").alias("state"),
    ), routed


ROUTED = "h(projector, types) AS (VALUES " + ", ".join(f"('{k}', {v!r})" for k, v in HANDLES.items()) + ")"
CHECKPOINTS = f"""{DBOX}, {ROUTED}, rt AS (SELECT * FROM db JOIN h ON list_contains(types, event_type)), ow AS (SELECT projector, max(outbox_id) AS last_outbox_id, arg_max(event_id, outbox_id) AS last_event_id, count(*) AS processed FROM rt
  WHERE status = 'delivered' AND outbox_id <= (SELECT max(event_id) * 9 / 10 FROM events) GROUP BY projector),
cp AS (SELECT projector, '1' AS version, last_outbox_id, CASE WHEN projector = 'agent' THEN last_event_id + 1 ELSE last_event_id END AS last_event_id, CASE WHEN projector = 'search' THEN processed - 2 ELSE processed END AS processed, 'running' AS state FROM ow)"""


def projection_status(spark, d):
    checkpoints, _ = _checkpoints(spark, d)
    return delivery.status(checkpoints.select("projector", "version", "last_outbox_id", "state"), _box(spark, d), _handles(spark))


STATUS_SQL = f"""WITH {CHECKPOINTS} SELECT projector, version, last_outbox_id, state, count(*) FILTER (outbox_id > last_outbox_id AND status <> 'dead_lettered') AS lag, count(*) FILTER (status = 'dead_lettered') AS dead,
  arg_max(error_class, (updated_at, outbox_id)) FILTER (error_class IS NOT NULL) AS last_error FROM rt JOIN cp USING (projector) GROUP BY ALL"""


def checkpoint_faults(spark, d):
    checkpoints, routed = _checkpoints(spark, d)
    return delivery.checkpoint_faults(checkpoints, routed.select("projector", "outbox_id", "event_id", "status"))


FAULTS_SQL = f"""WITH {CHECKPOINTS} SELECT projector, CASE WHEN projector = 'agent' THEN 'pointer' ELSE 'missed' END AS fault, (SELECT processed FROM ow WHERE ow.projector = cp.projector) AS delivered, processed FROM cp WHERE projector IN ('agent', 'search')"""


def projection_digest(spark, d):
    return delivery.projection_digest(_checkpoints(spark, d)[0])


DIGEST_SQL = f"WITH {CHECKPOINTS} SELECT 'pc1-' || sha256(string_agg(projector || '|' || version || '|' || last_outbox_id || '|' || state, chr(10) ORDER BY projector))[1:40] AS digest FROM cp"


def effective_times(spark, d):
    """Each order's window to the customer's next later order, read under a fixed instant and, for some customers, a backlog."""
    from chronofold.operators import bitemporal

    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    w = bitemporal.run_windows(o, "o_custkey", "o_orderdate", "o_orderkey")
    known = F.when(F.col("o_custkey") % 3 == 0, F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
    at, binds = delivery.effective_time(F.col("window_start"), F.col("window_end"), F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), known)
    return w.select("o_orderkey", at.alias("effective_at"), binds.alias("backlog_binds"))


EFFECTIVE_SQL = """WITH s AS (SELECT o_custkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS e FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)),
r AS (SELECT o_orderkey, o_custkey, least(CASE WHEN e IS NULL THEN greatest(o_orderdate, TIMESTAMP '1997-01-01') ELSE e - INTERVAL 1 MICROSECOND END, TIMESTAMP '1997-01-01') AS rec FROM orders JOIN s USING (o_custkey, o_orderdate))
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND TIMESTAMP '1996-01-01' < rec THEN TIMESTAMP '1996-01-01' ELSE rec END AS effective_at, o_custkey % 3 = 0 AND TIMESTAMP '1996-01-01' < rec AS backlog_binds FROM r"""


def history_markers(spark, d):
    """Markers of the regions that three readers agree on, and whether they open the gate."""
    r = table(spark, d, "region").select(F.lower("r_name").alias("projector"), F.lit("1").alias("version"), "r_regionkey")
    kept = delivery.narrowed([r, r.filter("r_regionkey < 4"), r.filter("r_regionkey > 0")])
    yes = delivery.history_gate(kept, {"asia": "1", "europe": "1"}).select(F.lit("asia, europe").alias("required"), "ready")
    no = delivery.history_gate(kept, {"asia": "1", "africa": "1"}).select(F.lit("asia, africa").alias("required"), "ready")
    return yes.unionByName(no)


MARKERS_SQL = """WITH m AS (SELECT lower(r_name) AS p FROM region WHERE r_regionkey BETWEEN 1 AND 3)
SELECT 'asia, europe' AS required, count(*) FILTER (p IN ('asia', 'europe')) = 2 AS ready FROM m UNION ALL SELECT 'asia, africa', count(*) FILTER (p IN ('asia', 'africa')) = 2 FROM m"""

QUERIES = {f.__name__: f for f in (outbox_claim, outbox_finalize, outbox_reopen, stream_quarantine, outbox_backlog, ledger_replay, replay_precheck, projection_status, checkpoint_faults, projection_digest, effective_times, history_markers)}
ORACLE_SQL = {
    "outbox_claim": CLAIM_SQL, "outbox_finalize": FINALIZE_SQL, "outbox_reopen": REOPEN_SQL, "stream_quarantine": QUARANTINE_SQL, "outbox_backlog": BACKLOG_SQL, "ledger_replay": REPLAY_SQL, "replay_precheck": PRECHECK_SQL,
    "projection_status": STATUS_SQL, "checkpoint_faults": FAULTS_SQL, "projection_digest": DIGEST_SQL, "effective_times": EFFECTIVE_SQL, "history_markers": MARKERS_SQL,
}
