"""Bitemporal, decision and failure queries with their SQL.

Runs are orders of a customer by date, files are parts, and a file's revision is its supplier.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import bitemporal as bt
from chronofold.operators import graph, timelines
from chronofold.sources.scratch import PART_BYTES, folded, parts
from chronofold.sources.tables import ledger, table
from chronofold.plans.ledger_queries import EV

CUT = "2024-01-20 00:00:00"


def _versions(spark, d):
    ev = ledger(spark, d)
    decision = (F.col("user_id") % 40).alias("decision_id")
    status = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "superseded").otherwise("accepted")
    target = F.when(F.col("event_type") == "purchase", (F.col("user_id") % 40 + 1) % 40)
    return ev.select("event_id", decision, status.alias("status"), target.alias("supersedes_id"), F.col("occurred_at").alias("valid_from"), F.col("observed_at").alias("recorded_at"))


def _decisions(spark, d):
    """Newest version at the cut; the earliest superseder whose own newest version names it closes it."""
    cut = F.lit(CUT).cast("timestamp_ntz")
    seen = _versions(spark, d).filter((F.col("valid_from") <= cut) & (F.col("recorded_at") <= cut))
    newest = seen.groupBy("decision_id").agg(F.max_by(F.struct("status", "supersedes_id", "valid_from", "event_id"), F.struct("recorded_at", "event_id")).alias("v")).select("decision_id", "v.*")
    closing = newest.filter("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("decision_id")).agg(F.min("valid_from").alias("superseded_at"))
    return newest.join(closing, "decision_id", "left")


def judged_decisions(spark, d):
    """``_decisions`` with the state each has at the cut; rejected ones go."""
    state = F.when(F.col("status") == "rejected", "dropped").when(F.col("superseded_at").isNotNull() & (F.col("superseded_at") <= F.lit(CUT).cast("timestamp_ntz")), "superseded").when(F.col("status") == "superseded", "superseded_undated").otherwise("active")
    return _decisions(spark, d).withColumn("state", state).filter("state <> 'dropped'")


def decisions_as_of(spark, d):
    return judged_decisions(spark, d).select("decision_id", "event_id", "valid_from", "superseded_at", "state")


VERSIONS = f"""{EV}, ver AS (SELECT event_id, user_id % 40 AS decision_id, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'superseded' ELSE 'accepted' END AS status,
  CASE WHEN event_type = 'purchase' THEN (user_id % 40 + 1) % 40 END AS supersedes_id, occurred_at AS valid_from, observed_at AS recorded_at FROM ev WHERE occurred_at <= TIMESTAMP '{CUT}' AND observed_at <= TIMESTAMP '{CUT}'),
newest AS (SELECT * FROM ver QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY recorded_at DESC, event_id DESC) = 1),
closing AS (SELECT supersedes_id AS decision_id, min(valid_from) AS superseded_at FROM newest WHERE supersedes_id IS NOT NULL GROUP BY 1)"""
DECISIONS_SQL = f"""WITH {VERSIONS} SELECT * FROM (SELECT decision_id, event_id, valid_from, superseded_at,
  CASE WHEN status = 'rejected' THEN 'dropped' WHEN superseded_at <= TIMESTAMP '{CUT}' THEN 'superseded' WHEN status = 'superseded' THEN 'superseded_undated' ELSE 'active' END AS state
  FROM newest LEFT JOIN closing USING (decision_id)) WHERE state <> 'dropped'"""


def decision_chain(spark, d):
    links = _decisions(spark, d).select(F.col("decision_id").alias("id"), F.col("supersedes_id").alias("next_id"))
    return graph.chain(links, links.select("id"), 6)


DECISION_CHAIN_SQL = f"""WITH RECURSIVE {VERSIONS}, walk AS (SELECT decision_id AS start, decision_id AS id, CAST(0 AS BIGINT) AS step, [decision_id] AS seen FROM newest
  UNION ALL SELECT w.start, n.supersedes_id, w.step + 1, list_append(w.seen, n.supersedes_id) FROM walk w JOIN newest n ON n.decision_id = w.id
  WHERE n.supersedes_id IS NOT NULL AND NOT list_contains(w.seen, n.supersedes_id) AND w.step < 6) SELECT start, id, step FROM walk"""


def decision_chain_both(spark, d):
    """Supersession from every decision both ways, fifty links deep: earlier decisions have steps above 0, later ones below."""
    links = _decisions(spark, d).select(F.col("decision_id").alias("id"), F.col("supersedes_id").alias("next_id"))
    return graph.chain_both(links, links.select("id"))


DECISION_CHAIN_BOTH_SQL = f"""WITH RECURSIVE {VERSIONS}, walk AS (SELECT decision_id AS start, decision_id AS id, CAST(0 AS BIGINT) AS step, [decision_id] AS seen FROM newest
  UNION ALL SELECT w.start, n.supersedes_id, w.step + 1, list_append(w.seen, n.supersedes_id) FROM walk w JOIN newest n ON n.decision_id = w.id
  WHERE n.supersedes_id IS NOT NULL AND NOT list_contains(w.seen, n.supersedes_id) AND w.step < 51),
back AS (SELECT start, start AS id, CAST(0 AS BIGINT) AS step, max_by(seen, step) AS seen FROM walk GROUP BY start
  UNION ALL SELECT b.start, n.decision_id, b.step - 1, list_append(b.seen, n.decision_id) FROM back b JOIN newest n ON n.supersedes_id = b.id WHERE NOT list_contains(b.seen, n.decision_id) AND b.step > -51),
every AS (SELECT start, id, step FROM walk UNION ALL SELECT start, id, step FROM back WHERE step < 0)
SELECT * FROM (SELECT start, id, step, max(abs(step)) OVER (PARTITION BY start) > 50 AS truncated FROM every) WHERE abs(step) <= 50"""


def _fixes(spark, d):
    ev = ledger(spark, d).filter("event_type in ('error', 'purchase')").withColumn("target", F.col("user_id") % 25)
    runs = ev.withColumn("failed", F.col("event_type") == "error").withColumn("passed", F.col("event_type") == "purchase")
    return bt.next_pass(runs, ["target"], ["occurred_at", "event_id"], "failed", "passed", "event_id")


def failure_fix_path(spark, d):
    return _fixes(spark, d).select("event_id", "target", "fixed_by")


FIX = f"""{EV}, fix AS (SELECT event_id, user_id % 25 AS target, user_id, event_type, occurred_at,
  first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id % 25 ORDER BY occurred_at, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fixed_by
  FROM ev WHERE event_type IN ('error', 'purchase'))"""
FIX_SQL = f"WITH {FIX} SELECT event_id, target, fixed_by FROM fix WHERE event_type = 'error'"


def failure_status(spark, d):
    """A failure (one per user) is resolved when the latest failing run of each of its targets has a later pass."""
    f = _fixes(spark, d)
    last = f.groupBy("user_id", "target").agg(F.max_by("fixed_by", F.struct("occurred_at", "event_id")).alias("fixed_by"), F.count("*").alias("n"), F.min("occurred_at").alias("first_seen"))
    return last.groupBy("user_id").agg(F.sum("n").alias("n_observed"), F.min("first_seen").alias("first_seen"), F.when(F.bool_and(F.col("fixed_by").isNotNull()), "resolved").otherwise("unresolved").alias("status"))


STATUS_SQL = f"""WITH {FIX}, l AS (SELECT user_id, target, last(fixed_by ORDER BY occurred_at, event_id) AS fixed_by, count(*) AS n, min(occurred_at) AS first_seen FROM fix WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n_observed, min(first_seen) AS first_seen, CASE WHEN bool_and(fixed_by IS NOT NULL) THEN 'resolved' ELSE 'unresolved' END AS status FROM l GROUP BY user_id"""


def _timeline(spark, d):
    """What a customer's orders say of its files: present with the smallest supplier, absent at the first order between that permits it (all but those of status P)."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    n, by_run = parts(o, line), parts(o, line, each=4 * PART_BYTES)
    runs = o.select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") != "P").alias("permits"))
    lines = line.select(F.col("l_orderkey").alias("run"), (F.col("l_partkey") % 8).alias("file_id"), F.col("l_suppkey").alias("revision")).repartition(by_run, "run")
    members = lines.join(runs.select("scope", "run").repartition(by_run, "run"), "run").withColumn("complete", F.lit(None).cast("boolean"))
    return timelines.with_absences(runs.repartition(n, "scope"), timelines.file_items(timelines.sightings(members.repartition(n, "scope"))))


def _intervals(spark, d):
    found = folded(bt.status_intervals(_timeline(spark, d), ["scope", "item"], ["at", "run"], "at", "status", "key"))
    return found.select(F.col("scope").alias("o_custkey"), F.col("item").alias("file_id"), "key", "valid_from", "valid_to")


def file_intervals(spark, d):
    return _intervals(spark, d)


INTERVALS = """m AS (SELECT o_custkey, o_orderkey, l_partkey % 8 AS file_id, min(l_suppkey) AS revision FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
g AS (SELECT o.o_custkey, f.file_id, o.o_orderkey, o.o_orderdate, m.revision, CASE WHEN m.revision IS NOT NULL THEN 'present' WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'absent' END AS status
  FROM orders o JOIN (SELECT DISTINCT o_custkey, file_id FROM m) f USING (o_custkey) LEFT JOIN m ON m.o_custkey = o.o_custkey AND m.o_orderkey = o.o_orderkey AND m.file_id = f.file_id),
p AS (SELECT *, lag(revision) OVER w AS prev, row_number() OVER w AS rn FROM g WHERE status <> 'unknown' WINDOW w AS (PARTITION BY o_custkey, file_id ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey, file_id ORDER BY o_orderdate, o_orderkey) AS valid_to FROM p WHERE rn = 1 OR prev IS DISTINCT FROM revision),
iv AS (SELECT o_custkey, file_id, revision AS key, o_orderdate AS valid_from, valid_to FROM c WHERE revision IS NOT NULL AND (valid_to IS NULL OR o_orderdate < valid_to))"""
INTERVALS_SQL = f"WITH {INTERVALS} SELECT * FROM iv"
POINTS = ["1994-01-01", "1995-07-01", "1997-01-01", "1999-10-01", "2024-01-15"]


def entity_as_of(spark, d):
    points = spark.createDataFrame([(p,) for p in POINTS], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    return bt.as_of(_intervals(spark, d), F.broadcast(points)).select("o_custkey", "file_id", "t", "key")  # five fixed points


AS_OF_SQL = f"WITH {INTERVALS}, pt AS (SELECT CAST(unnest({POINTS!r}) AS TIMESTAMP) AS t) SELECT o_custkey, file_id, t, key FROM iv JOIN pt ON valid_from <= t AND (valid_to IS NULL OR t < valid_to)"


def declared_clip(spark, d):
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("low"))
    iv = _intervals(spark, d).join(first, "o_custkey")
    return bt.clip(iv, F.col("low") + F.expr("interval 90 days"), F.col("low") + F.expr("interval 700 days")).select("o_custkey", "file_id", "key", "valid_from", "valid_to")


CLIP_SQL = f"""WITH {INTERVALS}, f AS (SELECT o_custkey, min(o_orderdate) AS low FROM orders GROUP BY 1),
x AS (SELECT o_custkey, file_id, key, greatest(valid_from, low + INTERVAL 90 DAY) AS valid_from, least(valid_to, low + INTERVAL 700 DAY) AS valid_to FROM iv JOIN f USING (o_custkey)) SELECT * FROM x WHERE valid_from < valid_to"""


def revision_window(spark, d):
    return bt.run_windows(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


WINDOW_SQL = """WITH s AS (SELECT o_custkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS window_end FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders))
SELECT o_custkey, o_orderkey, o_orderdate AS window_start, window_end FROM orders JOIN s USING (o_custkey, o_orderdate)"""


def revision_pick(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("complete"))
    return bt.pick_run(o, "o_custkey", "complete", ["o_orderdate", "o_orderkey"], "o_orderkey")


PICK_SQL = """SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS complete FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC) = 1"""


def run_diff(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = o.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("o_custkey", "o_orderkey", "r")
    line = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 8).alias("file_id"), "l_suppkey")
    member = last.join(line, last.o_orderkey == line.l_orderkey).groupBy("o_custkey", "r", "file_id").agg(F.min("l_suppkey").alias("revision"))
    return bt.run_diff(member.filter("r = 1").drop("r"), member.filter("r = 2").drop("r"), ["o_custkey", "file_id"], "revision")


DIFF_SQL = """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
m AS (SELECT o_custkey, r, l_partkey % 8 AS file_id, min(l_suppkey) AS revision FROM r JOIN lineitem ON l_orderkey = o_orderkey WHERE r <= 2 GROUP BY ALL)
SELECT * FROM (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.file_id, b.file_id) AS file_id,
  CASE WHEN b.revision IS NULL THEN 'added' WHEN a.revision IS NULL THEN 'removed' WHEN a.revision <> b.revision THEN 'modified' END AS change
  FROM (FROM m WHERE r = 1) a FULL JOIN (FROM m WHERE r = 2) b ON a.o_custkey = b.o_custkey AND a.file_id = b.file_id) WHERE change IS NOT NULL"""


def _assertions(spark, d):
    line = table(spark, d, "lineitem")
    return line.select((F.col("l_suppkey") % 50).alias("subject"), F.col("l_returnflag").alias("predicate"), (F.col("l_partkey") % 50).alias("object"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_linestatus", F.round(1 - F.col("l_discount"), 6).alias("confidence"), "l_linenumber")


def _winner(spark, d, unknown):
    rank = F.when(F.col("l_linenumber") == 1, 3).when(F.col("l_linestatus") == "O", 2).otherwise(unknown)
    return bt.evidence_winner(_assertions(spark, d), ["subject", "predicate", "object"], rank, "confidence", "id")


def evidence_winner(spark, d):
    return _winner(spark, d, 1)


def evidence_winner_at_revision(spark, d):
    return _winner(spark, d, 0)


def _winner_sql(unknown):
    return f"""WITH a AS (SELECT l_suppkey % 50 AS subject, l_returnflag AS predicate, l_partkey % 50 AS object, l_orderkey * 10 + l_linenumber AS id, round(1 - l_discount, 6) AS confidence,
  CASE WHEN l_linenumber = 1 THEN 3 WHEN l_linestatus = 'O' THEN 2 ELSE {unknown} END AS rank FROM lineitem)
SELECT subject, predicate, object, id AS winner, CAST(rank AS BIGINT) AS rank, confidence, count(*) OVER (PARTITION BY subject, predicate, object) - 1 AS n_lower FROM a
QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY rank DESC, confidence DESC, id) = 1"""


QUERIES = {f.__name__: f for f in (decisions_as_of, decision_chain, decision_chain_both, failure_fix_path, failure_status, file_intervals, entity_as_of, declared_clip, revision_window, revision_pick, run_diff, evidence_winner, evidence_winner_at_revision)}
ORACLE_SQL = {
    "decisions_as_of": DECISIONS_SQL, "decision_chain": DECISION_CHAIN_SQL, "decision_chain_both": DECISION_CHAIN_BOTH_SQL, "failure_fix_path": FIX_SQL, "failure_status": STATUS_SQL, "file_intervals": INTERVALS_SQL, "entity_as_of": AS_OF_SQL,
    "declared_clip": CLIP_SQL, "revision_window": WINDOW_SQL, "revision_pick": PICK_SQL, "run_diff": DIFF_SQL, "evidence_winner": _winner_sql(1), "evidence_winner_at_revision": _winner_sql(0),
}
