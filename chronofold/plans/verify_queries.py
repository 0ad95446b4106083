"""Ledger verification and failure resolution over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import failures, verification
from chronofold.plans.ledger_queries import EV
from chronofold.sources.tables import ledger, table

VALID, RECORDED = "1998-01-01 00:00:00", "1998-06-01 00:00:00"


def _chained(spark, d):
    """The ledger with payloads, envelopes and digests that cover their rows: odd events have no link, even ones cover the digest of the odd one before."""
    ev = ledger(spark, d)
    payload = F.to_json(F.struct("k", F.col("event_type").alias("type")))
    envelope = F.to_json(F.struct(F.col("event_id").alias("id"), F.lit("p1").alias("producer"), "stream_id"))
    rows = ev.select("stream_id", "event_id", "user_id", F.col("seq").alias("sequence"), payload.alias("payload"), envelope.alias("envelope"))
    rows = rows.withColumns({"payload_sha256": F.sha2("payload", 256), "producer_id": F.lit("p1"), "envelope_producer": F.get_json_object("envelope", "$.producer")})
    base = verification.event_digest(F.lit(None).cast("string"), F.col("envelope"), F.col("payload_sha256"))
    odd = F.col("sequence") % 2 == 1
    rows = rows.withColumn("base", base).withColumn("link", F.when(~odd, F.lag("base").over(Window.partitionBy("stream_id").orderBy("sequence"))))
    return rows.withColumn("event_sha256", F.when(odd, F.col("base")).otherwise(verification.event_digest(F.col("link"), F.col("envelope"), F.col("payload_sha256")))).drop("base")


def _pairs(spark, d):
    """Streams of two events: every second event starts one."""
    rows = _chained(spark, d)
    pair = F.floor((F.col("sequence") - 1) / 2)
    return rows.withColumn("stream_id", F.concat_ws(".", "stream_id", pair.cast("string"))).withColumn("sequence", (F.col("sequence") - 1) % 2 + 1)


def _heads(rows):
    last = rows.groupBy("stream_id").agg(F.max_by(F.struct("sequence", "event_id", "event_sha256", "user_id"), "sequence").alias("e"))
    return last.select("stream_id", F.col("e.sequence").alias("last_sequence"), F.col("e.event_id").alias("last_event_id"), F.col("e.event_sha256").alias("last_event_sha256"), F.col("e.user_id").alias("user_id"))


def _canonical():
    return F.to_json(F.from_json("payload", "k long, type string")) == F.col("payload")


def ledger_verify(spark, d):
    """A ledger damaged in nine ways, and a sound one of which the stored count is one too high."""
    sound = _pairs(spark, d)
    heads = _heads(sound)
    e = F.col("event_id")
    hurt = sound.withColumns({
        "sequence": F.when(e % 211 == 0, F.col("sequence") + 5).otherwise(F.col("sequence")),
        "link": F.when(e % 101 == 0, F.lit("bad")).otherwise(F.col("link")),
        "payload": F.when(e % 307 == 0, F.concat(F.lit(" "), "payload")).when(e % 503 == 0, F.to_json(F.struct((F.col("event_id") + 1).alias("k"), F.lit("x").alias("type")))).otherwise(F.col("payload")),
        "producer_id": F.when(e % 401 == 0, F.lit("p2")).otherwise(F.col("producer_id")),
        "envelope": F.when(e % 601 == 0, F.replace("envelope", F.lit("p1"), F.lit("p3"))).otherwise(F.col("envelope")),
    })
    wrong = heads.withColumn("last_sequence", F.when(F.col("last_event_id") % 97 == 0, F.col("last_sequence") + 1).otherwise(F.col("last_sequence"))).filter("last_event_id % 89 <> 0")
    asked = verification.stream_ids(hurt, wrong).union(spark.range(3).select(F.concat(F.lit("none"), F.col("id").cast("string"))))
    damaged = verification.verify_ledger(hurt, wrong, _canonical(), asked=asked).withColumn("ledger", F.lit("damaged"))
    count = table(spark, d, "events").count() + 1
    return damaged.unionByName(verification.verify_ledger(sound, heads, _canonical(), stored_count=count).withColumn("ledger", F.lit("sound")))


def ledger_verify_since(spark, d):
    """The same damage, walked from the second event on: what the first ones hide is found by their successors or not at all."""
    sound = _pairs(spark, d)
    e = F.col("event_id")
    hurt = sound.withColumn("link", F.when(e % 101 == 0, F.lit("bad")).otherwise(F.col("link"))).filter("event_id % 61 <> 0")
    return verification.walk(hurt, _canonical(), since=2)


SEALED = f"""{EV}, p AS (SELECT stream_id || '.' || ((seq - 1) // 2) AS stream_id, event_id, (seq - 1) % 2 + 1 AS sequence, '{{"k":' || k || ',"type":"' || event_type || '"}}' AS payload,
  '{{"id":' || event_id || ',"producer":"p1","stream_id":"' || stream_id || '"}}' AS env FROM ev),
q AS (SELECT *, sha256(payload) AS psha FROM p), b AS (SELECT *, sha256('0:' || strlen(env) || ':' || env || '64:' || psha) AS base FROM q),
l AS (SELECT *, CASE WHEN sequence = 2 THEN lag(base) OVER (PARTITION BY stream_id ORDER BY sequence) END AS link FROM b),
s AS (SELECT *, CASE WHEN sequence = 1 THEN base ELSE sha256('64:' || link || strlen(env) || ':' || env || '64:' || psha) END AS esha FROM l)"""
VERIFY_SQL = f"""WITH {SEALED}, h0 AS (SELECT stream_id, max(sequence) AS hs, arg_max(event_id, sequence) AS he, arg_max(esha, sequence) AS hd FROM s GROUP BY stream_id),
h AS (SELECT stream_id, CASE WHEN he % 97 = 0 THEN hs + 1 ELSE hs END AS hs, he, hd FROM h0 WHERE he % 89 <> 0),
d AS (SELECT stream_id, event_id, CASE WHEN event_id % 211 = 0 THEN sequence + 5 ELSE sequence END AS sequence, CASE WHEN event_id % 101 = 0 THEN 'bad' ELSE link END AS link,
  event_id % 307 = 0 AS undecodable, event_id % 503 = 0 AS changed, event_id % 401 = 0 AS other_producer, event_id % 601 = 0 AS other_envelope, esha FROM s),
w AS (SELECT *, lag(sequence) OVER o AS before, lag(esha) OVER o AS prev FROM d WINDOW o AS (PARTITION BY stream_id ORDER BY sequence, event_id)),
c AS (SELECT *, CASE WHEN sequence <> coalesce(before + 1, 1) THEN 'sequence' WHEN link IS DISTINCT FROM prev THEN 'previous_event_sha256' WHEN undecodable THEN 'event_decode' WHEN other_producer THEN 'producer_id'
  WHEN changed THEN 'payload_sha256' WHEN other_envelope THEN 'event_sha256' END AS chk FROM w),
f AS (SELECT stream_id, arg_min(chk, sequence) AS chk, min(sequence) AS at_sequence FROM c WHERE chk IS NOT NULL GROUP BY stream_id),
t AS (SELECT stream_id, max(sequence) AS ls, arg_max(event_id, sequence) AS le, arg_max(esha, sequence) AS ld FROM d GROUP BY stream_id),
r AS (SELECT t.stream_id, coalesce(f.chk, CASE WHEN h.stream_id IS NULL THEN 'stream_head_missing' WHEN hs <> ls OR he <> le OR hd <> ld THEN 'stream_head' END) AS "check", f.at_sequence
  FROM t LEFT JOIN f USING (stream_id) LEFT JOIN h USING (stream_id))
SELECT stream_id, "check", at_sequence, 'damaged' AS ledger FROM r WHERE "check" IS NOT NULL UNION ALL SELECT 'none' || i, 'stream_exists', NULL, 'damaged' FROM range(3) t(i)
UNION ALL SELECT NULL, 'event_count', NULL, 'sound'"""
SINCE_SQL = f"""WITH {SEALED}, d AS (SELECT stream_id, sequence, CASE WHEN event_id % 101 = 0 THEN 'bad' ELSE link END AS link, esha FROM s WHERE event_id % 61 <> 0),
w AS (SELECT *, lag(sequence) OVER o AS before, lag(esha) OVER o AS prev FROM d WINDOW o AS (PARTITION BY stream_id ORDER BY sequence))
SELECT stream_id, CASE WHEN before IS NULL THEN 'sequence' ELSE 'previous_event_sha256' END AS "check", sequence AS at_sequence FROM w WHERE sequence = 2 AND (before IS NULL OR link IS DISTINCT FROM prev)"""


def _runs(spark, d):
    """Orders as CI runs: a target is a customer's workflow (priority); F fails, O passes; recorded up to four days later."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("run_id"), F.col("o_custkey").alias("workflow"), F.col("o_orderpriority").alias("job"), (F.col("o_orderstatus") == "F").alias("failed"), (F.col("o_orderstatus") == "O").alias("passed"),
        F.col("o_orderdate").alias("completed_at"), (F.col("o_orderdate") + F.make_dt_interval(days=(k % 5).cast("int"))).alias("recorded_at"),
        F.when(k % 3 != 0, k % 4).alias("commit_id"), F.when(k % 2 == 0, k).alias("snapshot_id"),
    )


def _observations(spark, d):
    """A customer's failure is seen by its failing orders (CI), by pending ones (half of them test runs)."""
    r = _runs(spark, d).filter("not passed and workflow % 10 < 8")
    ci = F.col("failed") & (F.col("workflow") % 10 < 6)
    return r.select(
        F.col("run_id").alias("event_id"), F.col("workflow").alias("failure_id"), F.when(ci, F.col("run_id")).alias("ci_run_id"),
        F.when(~ci & (F.col("workflow") % 10 == 6), F.col("run_id")).alias("test_run_id"), F.col("completed_at").alias("valid_from"), "recorded_at",
    )


def _cuts():
    return F.lit(VALID).cast("timestamp_ntz"), F.lit(RECORDED).cast("timestamp_ntz")


def failure_fix_paths(spark, d):
    return failures.fix_paths(_observations(spark, d), _runs(spark, d), ["workflow", "job"], *_cuts())


def failure_resolution(spark, d):
    return failures.resolution(_observations(spark, d), _runs(spark, d), ["workflow", "job"], *_cuts())


def failure_resolution_capped(spark, d):
    """The newest 400 observations by the cuts: a failure that lost some of its own is unknown."""
    valid, recorded = _cuts()
    kept, cut = failures.newest_observations(_observations(spark, d).filter((F.col("valid_from") <= valid) & (F.col("recorded_at") <= recorded)), 400)
    return failures.resolution(kept, _runs(spark, d), ["workflow", "job"], *_cuts(), cut=cut)


RUNS = f"""r AS (SELECT o_orderkey AS run_id, o_custkey AS workflow, o_orderpriority AS job, o_orderstatus = 'F' AS failed, o_orderstatus = 'O' AS passed, o_orderdate AS completed_at,
  o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS recorded_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 END AS commit_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS snapshot_id FROM orders),
ob AS (SELECT run_id AS event_id, workflow AS failure_id, CASE WHEN failed AND workflow % 10 < 6 THEN run_id END AS ci_run_id, CASE WHEN NOT (failed AND workflow % 10 < 6) AND workflow % 10 = 6 THEN run_id END AS test_run_id,
  completed_at AS valid_from, recorded_at FROM r WHERE NOT passed AND workflow % 10 < 8)"""
SEEN = f"""v AS (SELECT * FROM r WHERE completed_at <= TIMESTAMP '{VALID}' AND recorded_at <= TIMESTAMP '{RECORDED}'), seen AS (SELECT * FROM src WHERE valid_from <= TIMESTAMP '{VALID}' AND recorded_at <= TIMESTAMP '{RECORDED}'),
fail AS (SELECT f.run_id, f.workflow, f.job, f.completed_at, f.commit_id, arg_min({{'id': p.run_id, 'at': p.completed_at, 'c': p.commit_id}}, (p.completed_at, p.run_id)) FILTER (p.run_id IS NOT NULL) AS fix
  FROM v f LEFT JOIN v p ON p.workflow = f.workflow AND p.job = f.job AND p.passed AND (p.commit_id IS NOT NULL OR p.snapshot_id IS NOT NULL) AND (p.completed_at, p.run_id) > (f.completed_at, f.run_id) WHERE f.failed GROUP BY ALL),
path AS (SELECT failure_id, workflow, job, run_id, completed_at, fix.id AS fixed_by, fix.at AS fixed_at, commit_id <> fix.c AS commit_changed FROM (SELECT s.failure_id, fail.* FROM seen s JOIN fail ON fail.run_id = s.ci_run_id)
  QUALIFY row_number() OVER (PARTITION BY failure_id, workflow, job ORDER BY completed_at DESC, run_id DESC) = 1)"""
FIX_PATHS_SQL = f"WITH {RUNS}, src AS (FROM ob), {SEEN} SELECT * FROM path"
STATUS = """facts AS (SELECT s.failure_id, count(*) AS n_observed, min(valid_from) AS first_seen, max(coalesce(v.completed_at, valid_from)) AS last_seen, count(ci_run_id) AS n_ci, count(test_run_id) AS n_test
  FROM seen s LEFT JOIN v ON v.run_id = s.ci_run_id GROUP BY ALL),
pt AS (SELECT failure_id, bool_and(fixed_by IS NOT NULL) AS all_fixed, arg_max({'at': fixed_at}, (completed_at, run_id)).at AS closed_at FROM path GROUP BY failure_id)
SELECT failure_id, n_observed, first_seen, last_seen, CASE WHEN is_cut THEN 'unknown' WHEN all_fixed AND last_seen <= closed_at THEN 'resolved' WHEN n_ci > 0 THEN 'unresolved' WHEN n_test > 0 THEN 'unsupported' ELSE 'unknown' END AS status
FROM facts LEFT JOIN pt USING (failure_id)"""
RESOLUTION_SQL = f"WITH {RUNS}, src AS (FROM ob), {SEEN}, {STATUS.replace('is_cut', 'false')}"
CAPPED_SQL = f"""WITH {RUNS}, oc AS (SELECT * FROM ob WHERE valid_from <= TIMESTAMP '{VALID}' AND recorded_at <= TIMESTAMP '{RECORDED}'), n AS (SELECT *, row_number() OVER (ORDER BY recorded_at DESC, event_id DESC) AS place FROM oc),
src AS (SELECT * EXCLUDE (place) FROM n WHERE place <= 400 AND failure_id NOT IN (SELECT failure_id FROM n WHERE place = 401)),
cut AS (SELECT failure_id FROM (SELECT failure_id, count(*) AS k FROM src GROUP BY ALL) JOIN (SELECT failure_id, count(*) AS n FROM oc GROUP BY ALL) USING (failure_id) WHERE k < n), {SEEN}, {STATUS.replace('is_cut', 'failure_id IN (SELECT failure_id FROM cut)')}"""

QUERIES = {f.__name__: f for f in (ledger_verify, ledger_verify_since, failure_fix_paths, failure_resolution, failure_resolution_capped)}
ORACLE_SQL = {"ledger_verify": VERIFY_SQL, "ledger_verify_since": SINCE_SQL, "failure_fix_paths": FIX_PATHS_SQL, "failure_resolution": RESOLUTION_SQL, "failure_resolution_capped": CAPPED_SQL}
