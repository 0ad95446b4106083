"""The five questions over the driver's tables, four of them with SQL.

The world: the code graph of ``graph_read_queries`` (its calls, references and imports), decisions of the ledger, failures of the orders, and the best lexical hits.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from chronofold.operators import answers, context
from chronofold.plans import graph_read_queries as code
from chronofold.plans import history_queries, retrieval_queries, verify_queries
from chronofold.sources.scratch import cut_lineage
from chronofold.sources.tables import table

SEEN = "2024-01-01 00:00:00"


def _time(column):
    return F.col(column).cast("timestamp")


def _code(spark, d):
    seen = F.lit(SEEN).cast("timestamp")
    n = code._nodes(spark, d).filter("current and repository_id = 'r0'")
    nodes = n.select("id", "kind", F.concat(F.lit("shop."), "id").alias("name"), F.concat(F.lit("src/"), "id").alias("path"), seen.alias("observed"), F.array(F.concat(F.lit("n:"), "id")).alias("citations"))
    e = code._edges(spark, d).filter("type in ('CALLS', 'REFERENCES', 'IMPORTS', 'DEPENDS_ON')")
    edges = e.select(F.col("assertion_id").alias("id"), "src", "dst", "type", "evidence", "confidence", F.lit(None).cast("string").alias("review"), seen.alias("observed"), F.array(F.concat(F.lit("e:"), "assertion_id")).alias("citations"))
    return {"nodes": nodes, "edges": edges}


def _decisions(spark, d):
    v = history_queries.judged_decisions(spark, d)
    name = lambda c: F.concat(F.lit("d"), F.col(c).cast("string"))
    by = v.filter("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("decision_id")).agg(F.min("decision_id").alias("by"))
    return v.join(by, "decision_id", "left").select(
        name("decision_id").alias("id"), "status", F.col("state").alias("standing"), F.array(F.concat(F.lit("s"), F.col("decision_id").cast("string"))).alias("subjects"), name("supersedes_id").alias("supersedes_id"),
        F.when(F.col("state") == "superseded", name("by")).alias("superseded_by"), _time("valid_from").alias("recorded_at"), F.array(F.concat(F.lit("v:"), F.col("event_id").cast("string"))).alias("citations"),
    )


def _failures(spark, d):
    x = verify_queries.failure_resolution(spark, d)
    f = F.col("failure_id")
    return x.select(
        F.concat(F.lit("x"), f.cast("string")).alias("id"), F.concat(F.lit("part"), (f % 5).cast("string")).alias("component"), F.concat(F.lit("step"), (f % 3).cast("string")).alias("operation"), F.lit("RunFailed").alias("error_class"), (f % 50).cast("string").alias("fingerprint"),
        _time("first_seen").alias("valid_from"), F.array(_time("last_seen")).alias("observed_at"), F.col("status").alias("resolution"), F.array(F.concat(F.lit("x:"), f.cast("string"))).alias("citations"),
    )


def _hits(spark, d):
    seen = F.lit(SEEN).cast("timestamp")
    h = retrieval_queries.lexical_or_topk_all(spark, d)
    return h.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("content_id"), F.lit("lexical").alias("source"), F.col("score").cast("double").alias("score"), F.lit("an excerpt").alias("excerpt"), seen.alias("observed"), F.array(F.concat(F.lit("c:"), F.col("doc_id").cast("string"))).alias("citations"))


def _stored(parts):
    """What the walk and the matches read many times is written once, as it would lie in a store."""
    return {name: cut_lineage(part) for name, part in parts.items()}


def _shown(ranked):
    return ranked.select("item_id", "kind", "score", "rank", "capped")


def question_task(spark, d):
    read_often = _stored({**_code(spark, d), "failures": _failures(spark, d), "hits": _hits(spark, d)})
    return _shown(context.context_for_task(context.World(**read_often, decisions=_decisions(spark, d)), "why does shopF3 fail in part1 at step2"))


def question_overview(spark, d):
    changes = table(spark, d, "region").select(F.concat(F.lit("g"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("added").alias("change"), F.lit(SEEN).cast("timestamp").alias("observed"), F.array("r_name").alias("citations"))
    # each table is read once, so its filters reach the scans
    return _shown(context.repository_overview(context.World(**_code(spark, d), decisions=_decisions(spark, d), failures=_failures(spark, d)), changes))


def question_symbol(spark, d):
    return _shown(context.symbol_context(context.World(**_stored(_code(spark, d)), decisions=_decisions(spark, d)), "s5"))


def question_decisions(spark, d):
    return _shown(context.decision_history(context.World(decisions=_decisions(spark, d), **_stored({"hits": _hits(spark, d)})), ""))


def question_failures(spark, d):
    return _shown(context.failure_history(context.World(failures=_failures(spark, d)), datetime(1993, 1, 1), datetime(1997, 1, 1), fingerprint="7"))


SCORED = """q AS (SELECT *, CASE WHEN (SELECT count(DISTINCT seen_at) FROM u) = 1 THEN 1.0::DOUBLE ELSE (dense_rank() OVER (ORDER BY seen_at) - 1)::DOUBLE / ((SELECT count(DISTINCT seen_at) FROM u) - 1) END AS rec FROM u),
s AS (SELECT item_id, kind, CAST(round_even((100 * p + 4 * t + 6 + CASE WHEN dist IS NULL THEN 0.0::DOUBLE ELSE 20.0::DOUBLE / (1 + dist) END + 40.0::DOUBLE * m + 3.0::DOUBLE * rec) * 1000000, 0) AS BIGINT) AS score FROM q),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, item_id) AS rank, count(*) OVER () > 500 AS capped FROM s) SELECT item_id, kind, score, rank, capped FROM rk WHERE rank <= 500"""
DECIDED = f"""{history_queries.VERSIONS}, dc AS (SELECT * FROM (SELECT decision_id, status, valid_from, CASE WHEN status = 'rejected' THEN 'dropped' WHEN superseded_at <= TIMESTAMP '{history_queries.CUT}' THEN 'superseded'
  WHEN status = 'superseded' THEN 'superseded_undated' ELSE 'active' END AS standing FROM newest LEFT JOIN closing USING (decision_id)) WHERE standing <> 'dropped')"""
FAILED = verify_queries.RESOLUTION_SQL.removeprefix("WITH ").replace("\nSELECT failure_id, n_observed", ",\nfx AS (SELECT failure_id, n_observed") + ")"
DECISIONS_SQL = f"""WITH {DECIDED}, u AS (SELECT 'decision:d' || decision_id AS item_id, 'decision' AS kind, CASE WHEN standing = 'active' THEN 1 ELSE 0 END AS p, CASE WHEN status = 'accepted' THEN 4 ELSE 2 END AS t, NULL AS dist, 0.0 AS m, valid_from AS seen_at FROM dc), {SCORED}"""
FAILURES_SQL = f"""WITH {FAILED}, u AS (SELECT 'failure:x' || failure_id AS item_id, 'failure' AS kind, 0 AS p, CASE WHEN status = 'resolved' THEN 4 ELSE 3 END AS t, NULL AS dist, 1.0 AS m, first_seen AS seen_at FROM fx WHERE failure_id % 50 = 7
  AND (first_seen >= TIMESTAMP '1993-01-01' AND first_seen < TIMESTAMP '1997-01-01' OR last_seen >= TIMESTAMP '1993-01-01' AND last_seen < TIMESTAMP '1997-01-01')), {SCORED}"""
OVERVIEW_SQL = f"""WITH {FAILED}, {DECIDED.replace("WITH ", "")}, {code.GRAPH}, u AS (SELECT 'module:m' || n_nationkey AS item_id, 'module' AS kind, 2 AS p, 4 AS t, NULL AS dist, 0.0 AS m, TIMESTAMP '{SEEN}' AS seen_at FROM nation
  UNION ALL SELECT 'dependency:' || type || '|' || src || '|' || dst, 'dependency', 1, 3, NULL, 0.0, TIMESTAMP '{SEEN}' FROM ed WHERE type = 'DEPENDS_ON' UNION ALL SELECT 'change:g' || r_regionkey, 'change', 2, 5, NULL, 0.0, TIMESTAMP '{SEEN}' FROM region
  UNION ALL SELECT 'decision:d' || decision_id, 'decision', 3, CASE WHEN status = 'accepted' THEN 4 ELSE 2 END, NULL, 0.0, valid_from FROM dc WHERE standing = 'active' UNION ALL SELECT 'failure:x' || failure_id, 'failure', 3, 3, NULL, 0.0, first_seen FROM fx WHERE status <> 'resolved'), {SCORED}"""
SYMBOL_SQL = f"""WITH {DECIDED}, {code.GRAPH}, wd AS (SELECT * FROM ed WHERE type IN ('CALLS', 'REFERENCES', 'IMPORTS', 'DEPENDS_ON')), bo AS (SELECT src, dst FROM wd UNION SELECT dst, src FROM wd), d1 AS (SELECT DISTINCT dst AS id FROM bo WHERE src = 's5' AND dst <> 's5'),
re AS (SELECT 's5' AS id, 0 AS distance UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT DISTINCT dst, 2 FROM bo JOIN d1 ON src = d1.id WHERE dst <> 's5' AND dst NOT IN (SELECT id FROM d1)),
u AS (SELECT 'symbol:s5' AS item_id, 'symbol' AS kind, 5 AS p, 4 AS t, 0 AS dist, 1.0 AS m, TIMESTAMP '{SEEN}' AS seen_at
  UNION ALL SELECT 'relation:' || type || '|' || src || '|' || dst, 'relation', CASE WHEN src = 's5' OR dst = 's5' THEN 4 ELSE 2 END, CASE type WHEN 'CALLS' THEN 2 ELSE 3 END, least(a.distance, b.distance), 0.0, TIMESTAMP '{SEEN}' FROM wd JOIN re a ON a.id = src JOIN re b ON b.id = dst
  UNION ALL SELECT 'decision:d' || decision_id, 'decision', 3, CASE WHEN status = 'accepted' THEN 4 ELSE 2 END, NULL, 1.0, valid_from FROM dc WHERE decision_id = 5), {SCORED}"""

QUERIES = {f.__name__: f for f in (question_task, question_overview, question_symbol, question_decisions, question_failures)}
ORACLE_SQL = {"question_overview": OVERVIEW_SQL, "question_symbol": SYMBOL_SQL, "question_decisions": DECISIONS_SQL, "question_failures": FAILURES_SQL}
