"""Folds of agent, repository, run and decision events over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import folds
from chronofold.plans.ledger_queries import EV
from chronofold.sources.tables import ledger, table

STEPS = [
    ("session", "started"), ("session", "ended"), ("turn", "started"), ("turn", "stopped"), ("turn", "completed"),
    ("tool_call", "started"), ("tool_call", "output_observed"), ("tool_call", "completed"),
]
HANDLES = {"agent": ["signup", "click", "view"], "quality": ["error", "purchase"], "search": ["view", "purchase", "error"]}


def projector_routing(spark, d):
    return folds.routed(table(spark, d, "events"), HANDLES).groupBy("place", "projector", "event_type").agg(F.count("*").alias("n"))


ROUTING_SQL = "WITH h(place, projector, types) AS (VALUES " + ", ".join(f"({i}, '{k}', {v!r})" for i, (k, v) in enumerate(HANDLES.items())) + """)
SELECT CAST(place AS BIGINT) AS place, projector, event_type, count(*) AS n FROM events JOIN h ON list_contains(types, event_type) GROUP BY ALL"""


def _agent(spark, d):
    """Events as agent events: a user is a session, ten of its events in order a turn, three a tool call; the step follows from the event's number."""
    ev = ledger(spark, d)
    step = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("step")) for k, s in STEPS])[(F.col("event_id") % 8).cast("int")]
    turn = folds.node_id("turn", F.col("stream_id"), F.floor(F.col("seq") / 10).cast("string"))
    call = folds.node_id("tool_call", F.col("stream_id"), F.floor(F.col("seq") / 3).cast("string"))
    ident = F.when(F.col("s.kind") == "session", F.col("stream_id")).when(F.col("s.kind") == "turn", turn).otherwise(call)
    return ev.withColumn("s", step).select(
        "s.kind", "s.step", ident.alias("node_id"), F.col("stream_id").alias("session_id"), F.when(F.col("s.kind") == "tool_call", turn).alias("turn_node"), "occurred_at", "event_id",
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("model"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("p"), (F.col("k") % 2).cast("string"))).alias("project_id"),
    )


def _agent_edges(ev):
    has = ev.filter("kind = 'turn'").select(F.lit("HAS_TURN").alias("type"), F.col("session_id").alias("src"), F.col("node_id").alias("dst"), "event_id")
    invoked = ev.filter("kind = 'tool_call'").select(F.lit("INVOKED").alias("type"), F.col("turn_node").alias("src"), F.col("node_id").alias("dst"), "event_id")
    return has, invoked


def agent_nodes(spark, d):
    ev = _agent(spark, d)
    has, invoked = _agent_edges(ev)
    nodes = folds.with_stubs(folds.agent_nodes(ev), has, {"src": "session"})
    return folds.with_stubs(nodes.drop("stub"), invoked, {"src": "turn"}).drop("stub").withColumn("stub", F.col("n_events").isNull())


def agent_edges(spark, d):
    has, invoked = _agent_edges(_agent(spark, d))
    return folds.merged_edges(has.unionByName(invoked))


def agent_provenance(spark, d):
    return folds.sources(_agent(spark, d), ["kind", "node_id"])


def _case(i):
    return "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN '{s[i]}'" for k, s in enumerate(STEPS)) + " END"


AGENT = f"""{EV}, a0 AS (SELECT *, {_case(0)} AS kind, {_case(1)} AS step, 'turn:' || length(stream_id) || ':' || stream_id || ':' || (seq // 10) AS turn,
  'tool_call:' || length(stream_id) || ':' || stream_id || ':' || (seq // 3) AS call FROM ev),
a AS (SELECT kind, step, CASE kind WHEN 'session' THEN stream_id WHEN 'turn' THEN turn ELSE call END AS node_id, stream_id, turn, occurred_at, event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS model,
  CASE WHEN event_id % 3 = 0 THEN 'p' || (k % 2) END AS project_id FROM a0),
ed AS (SELECT 'HAS_TURN' AS type, stream_id AS src, node_id AS dst, event_id FROM a WHERE kind = 'turn' UNION ALL SELECT 'INVOKED', turn, node_id, event_id FROM a WHERE kind = 'tool_call'),
nd AS (SELECT kind, node_id, first(step ORDER BY CASE step WHEN 'started' THEN 0 WHEN 'stopped' THEN 1 WHEN 'output_observed' THEN 1 ELSE 2 END DESC, occurred_at, event_id) AS status,
  min(occurred_at) FILTER (step = 'started') AS started_at, min(occurred_at) FILTER (step IN ('completed', 'ended')) AS ended_at,
  last({{'m': model}} ORDER BY occurred_at, event_id) FILTER (step = 'started').m AS model, min(project_id) AS project_id, coalesce(min(project_id) <> max(project_id), false) AS scope_conflict, count(*) AS n_events FROM a GROUP BY ALL)"""
AGENT_NODES_SQL = f"""WITH {AGENT}, st AS (SELECT DISTINCT CASE type WHEN 'HAS_TURN' THEN 'session' ELSE 'turn' END AS kind, src AS node_id FROM ed)
SELECT *, n_events IS NULL AS stub FROM nd FULL JOIN st USING (kind, node_id)"""
AGENT_EDGES_SQL = f"WITH {AGENT} SELECT type, src, dst, min(event_id) AS first_source, count(DISTINCT event_id) AS n_sources FROM ed GROUP BY ALL"
PROVENANCE_SQL = f"WITH {AGENT} SELECT DISTINCT kind, node_id, event_id FROM a"


def _commits(spark, d):
    """Orders as checkout observations (a customer's checkout, its head an order) and, but for every fourth, as commits with one or two parents."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    oid = lambda x: F.sha1(x.cast("string"))
    return o.select(
        k.alias("event_id"), F.col("o_orderdate").alias("occurred_at"), F.concat(F.lit("co"), F.col("o_custkey").cast("string")).alias("checkout_id"), F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string")).alias("repository_id"),
        F.when(k % 9 != 0, oid(k)).alias("head_commit"), F.when(k % 6 != 0, F.col("o_orderpriority")).alias("branch"), (k % 6 == 0).alias("detached"), (k % 4 != 0).alias("is_commit"), oid(k).alias("oid"), oid(-k).alias("tree_id"),
        F.filter(F.array(F.when(k > 1, oid(k - 1)), F.when(k % 5 == 0, oid(k - 3))), lambda x: x.isNotNull()).alias("parents"),
    )


def checkout_fold(spark, d):
    """Checkouts: head pointer, branch and detached flag of the newest observation together, the repository once."""
    return folds.newest(_commits(spark, d), ["checkout_id"], ["head_commit", "branch", "detached", "event_id"], ["repository_id"])


def commit_fold(spark, d):
    """Commits with their tree and earliest time, and stubs for those only named as a head or a parent."""
    c = _commits(spark, d)
    own = F.col("repository_id")
    full = c.filter("is_commit").groupBy(folds.node_id("commit", own, F.col("oid")).alias("node_id")).agg(F.min("tree_id").alias("tree_id"), F.min("occurred_at").alias("observed_at")).withColumn("kind", F.lit("Commit"))
    parents = c.filter("is_commit").select("repository_id", F.explode("parents").alias("oid"))
    heads = c.filter("head_commit is not null").select("repository_id", F.col("head_commit").alias("oid"))
    named = parents.unionByName(heads).select(folds.node_id("commit", own, F.col("oid")).alias("dst"))
    return folds.with_stubs(full, named, {"dst": "Commit"})


COMMITS = """c AS (SELECT o_orderkey AS event_id, o_orderdate AS occurred_at, 'co' || o_custkey AS checkout_id, 'r' || (o_custkey % 7) AS repository_id, CASE WHEN o_orderkey % 9 <> 0 THEN sha1(CAST(o_orderkey AS VARCHAR)) END AS head_commit,
  CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS branch, o_orderkey % 6 = 0 AS detached, o_orderkey % 4 <> 0 AS is_commit, sha1(CAST(o_orderkey AS VARCHAR)) AS oid, sha1(CAST(-o_orderkey AS VARCHAR)) AS tree_id,
  list_filter([CASE WHEN o_orderkey > 1 THEN sha1(CAST(o_orderkey - 1 AS VARCHAR)) END, CASE WHEN o_orderkey % 5 = 0 THEN sha1(CAST(o_orderkey - 3 AS VARCHAR)) END], lambda x: x IS NOT NULL) AS parents FROM orders)"""
CHECKOUT_SQL = f"WITH {COMMITS}, m AS (SELECT checkout_id, min(repository_id) AS repository_id FROM c GROUP BY 1) SELECT checkout_id, head_commit, branch, detached, event_id, m.repository_id FROM c JOIN m USING (checkout_id) QUALIFY row_number() OVER (PARTITION BY checkout_id ORDER BY occurred_at DESC, event_id DESC) = 1"
COMMIT_SQL = f"""WITH {COMMITS}, f AS (SELECT 'commit:' || length(repository_id) || ':' || repository_id || ':' || oid AS node_id, min(tree_id) AS tree_id, min(occurred_at) AS observed_at FROM c WHERE is_commit GROUP BY 1),
n AS (SELECT repository_id, unnest(parents) AS oid FROM c WHERE is_commit UNION SELECT repository_id, head_commit FROM c WHERE head_commit IS NOT NULL),
s AS (SELECT DISTINCT 'commit:' || length(repository_id) || ':' || repository_id || ':' || oid AS node_id FROM n)
SELECT 'Commit' AS kind, node_id, tree_id, observed_at, tree_id IS NULL AS stub FROM f FULL JOIN s USING (node_id)"""


def _test_runs(spark, d):
    """Order lines as observations of a run (an order), later ones correcting earlier ones; a line validates a commit (supplier), else a snapshot (part)."""
    line = table(spark, d, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("run_id"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000).alias("event_id"), F.col("l_shipdate").alias("occurred_at"), F.col("l_shipdate").alias("recorded_at"),
        F.when(F.col("l_linestatus") == "F", "failed").otherwise("passed").alias("status"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("n_tests"),
        F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("commit_id"), F.when(F.col("l_returnflag") == "N", F.col("l_partkey")).alias("snapshot_id"),
    )


def run_results(spark, d):
    return folds.newest(_test_runs(spark, d), ["run_id"], ["status", "n_tests", "event_id"], ["recorded_at"])


def validates_edges(spark, d):
    return folds.edges_of_newest(_test_runs(spark, d), "run_id", {"commit_id": "Commit", "snapshot_id": "WorkspaceSnapshot"}, "VALIDATES")


TESTS = """t AS (SELECT l_orderkey AS run_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS event_id, l_shipdate AS seen_at, CASE l_linestatus WHEN 'F' THEN 'failed' ELSE 'passed' END AS status, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS n_tests,
  CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS commit_id, CASE WHEN l_returnflag = 'N' THEN l_partkey END AS snapshot_id, min(l_shipdate) OVER (PARTITION BY l_orderkey) AS recorded_at FROM lineitem),
l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seen_at DESC, event_id DESC) = 1)"""
RESULTS_SQL = f"WITH {TESTS} SELECT run_id, status, n_tests, event_id, recorded_at FROM l"
VALIDATES_SQL = f"""WITH {TESTS} SELECT 'VALIDATES' AS type, run_id AS src, commit_id AS dst, 'Commit' AS dst_kind, event_id FROM l WHERE commit_id IS NOT NULL
UNION ALL SELECT 'VALIDATES', run_id, snapshot_id, 'WorkspaceSnapshot', event_id FROM l WHERE snapshot_id IS NOT NULL"""


def supersession_edges(spark, d):
    """Decisions (a user's events) name the next user's; only the newest recording of each counts."""
    ev = ledger(spark, d)
    status = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "superseded").otherwise("accepted")
    return folds.supersession_of_newest(ev.select(F.col("user_id").alias("decision_id"), status.alias("status"), F.when(F.col("k") % 2 == 0, F.col("user_id") + 1).alias("supersedes_id"), "occurred_at", "event_id"))


SUPERSESSION_SQL = f"""WITH {EV} SELECT user_id AS decision_id, user_id + 1 AS supersedes_id FROM (FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, event_id DESC) = 1) WHERE k % 2 = 0 AND event_type <> 'error'"""

QUERIES = {f.__name__: f for f in (projector_routing, agent_nodes, agent_edges, agent_provenance, checkout_fold, commit_fold, run_results, validates_edges, supersession_edges)}
ORACLE_SQL = {
    "projector_routing": ROUTING_SQL, "agent_nodes": AGENT_NODES_SQL, "agent_edges": AGENT_EDGES_SQL, "agent_provenance": PROVENANCE_SQL, "checkout_fold": CHECKOUT_SQL, "commit_fold": COMMIT_SQL,
    "run_results": RESULTS_SQL, "validates_edges": VALIDATES_SQL, "supersession_edges": SUPERSESSION_SQL,
}
