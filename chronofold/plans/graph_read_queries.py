"""Bounded graph reads over the driver's tables, with their SQL.

The code graph: nations are modules, suppliers files, parts symbols; a file is in its nation's module and defines the parts it sells; a part calls, references
or imports the next one that shares an order with it.  Everything is of repository 'r0' but the suppliers whose key ends in 9.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import graph_reads as g
from chronofold.sources.scratch import parts
from chronofold.sources.tables import table

R = "r0"


def _nodes(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("module").alias("kind"), F.lit(R).alias("repository_id"), F.lit(True).alias("current"))
    s = table(spark, d, "supplier")
    files = s.select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("file").alias("kind"), F.when(F.col("s_suppkey") % 10 == 9, "r1").otherwise(R).alias("repository_id"), (F.col("s_suppkey") % 7 != 0).alias("current"))
    p = table(spark, d, "part")
    symbols = p.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"), F.lit("symbol").alias("kind"), F.lit(R).alias("repository_id"), (F.col("p_size") != 1).alias("current"))
    repo = spark.range(1).select(F.lit(R).alias("id"), F.lit("repository").alias("kind"), F.lit(R).alias("repository_id"), F.lit(True).alias("current"))
    return n.unionByName(files).unionByName(symbols).unionByName(repo)


def _edges(spark, d):
    """type, src, dst and the rest of an edge; the assertion of an edge is its own name."""
    line = table(spark, d, "lineitem")
    f = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    s = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    defines = line.filter("l_linenumber = 1").select(F.lit("DEFINES").alias("type"), f("l_suppkey").alias("src"), s("l_partkey").alias("dst"))
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    n = parts(line)
    code = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").repartition(n, "l_orderkey").withColumn("next_part", after).filter("next_part is not null")
    kind = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "R", "REFERENCES").otherwise("IMPORTS")
    calls = code.select(kind.alias("type"), s("l_partkey").alias("src"), F.concat(F.lit("s"), F.col("next_part").cast("string")).alias("dst"))
    sup = table(spark, d, "supplier")
    inside = sup.select(F.lit("IN_MODULE").alias("type"), f("s_suppkey").alias("src"), F.concat(F.lit("m"), F.col("s_nationkey").cast("string")).alias("dst"))
    top = sup.select(F.lit("IN_REPOSITORY").alias("type"), f("s_suppkey").alias("src"), F.lit(R).alias("dst"))
    needs = line.filter("l_linenumber = 2").select(F.lit("DEPENDS_ON").alias("type"), f("l_suppkey").alias("src"), F.concat(F.lit("ext:"), "l_returnflag").alias("dst"))
    every = defines.unionByName(calls).unionByName(inside).unionByName(top).unionByName(needs).repartition(n, "src", "dst").distinct()
    return every.select(
        "type", "src", "dst", F.lit(R).alias("repository_id"), F.concat_ws("|", "type", "src", "dst").alias("assertion_id"), F.when(F.col("type") == "CALLS", 0.5).otherwise(0.9).alias("confidence"), F.lit("tree_sitter").alias("evidence"),
    )


def _assertions(spark, d):
    """Every code edge's own assertion, seen in one or two revisions, a weaker one of the same triple, and one that holds no longer."""
    e = _edges(spark, d).filter(F.col("type").isin(g.CODE))
    base = e.select("repository_id", F.col("src").alias("subject"), F.col("type").alias("predicate"), F.col("dst").alias("object"), "assertion_id")
    shown = F.when(F.col("predicate") == "CALLS", F.array(F.lit("v1"), F.lit("v2"))).otherwise(F.array(F.lit("v1")))
    own = base.select("*", F.lit(True).alias("current"), F.explode(shown).alias("revision_id"))
    weak = base.filter("predicate = 'CALLS'").withColumn("assertion_id", F.concat("assertion_id", F.lit("~weak"))).select("*", F.lit(True).alias("current"), F.lit("v1").alias("revision_id"))
    old = base.filter("predicate = 'IMPORTS'").withColumn("assertion_id", F.concat("assertion_id", F.lit("~old"))).select("*", F.lit(False).alias("current"), F.lit("v0").alias("revision_id"))
    return own.unionByName(weak).unionByName(old)


def _walk(spark, d, anchor, depth, mode, cap=g.NODES):
    seen, truncated = g.walk(_nodes(spark, d), _edges(spark, d), R, anchor, depth, mode, cap)
    return seen.select("id", "kind", F.col("distance").cast("long").alias("distance"), F.lit(truncated).alias("truncated"))


def code_neighborhood(spark, d):
    return _walk(spark, d, "m3", 3, "neighborhood")


def code_neighborhood_capped(spark, d):
    """The whole repository two levels down, cut at 40 nodes."""
    return _walk(spark, d, R, 2, "neighborhood", 40)


def code_callers(spark, d):
    return _walk(spark, d, "s5", 2, "callers")


def code_callees(spark, d):
    return _walk(spark, d, "s5", 2, "callees")


def code_edges(spark, d):
    seen, _ = g.walk(_nodes(spark, d), _edges(spark, d), R, "s5", 1, "neighborhood")
    out, cut = g.evidence_edges(_edges(spark, d), _assertions(spark, d), seen, R)
    return out.crossJoin(F.broadcast(cut)).select("type", "src", "dst", "confidence", F.array_join("revisions", ",").alias("revisions"), "truncated")  # one row


def code_alternatives(spark, d):
    seen, _ = g.walk(_nodes(spark, d), _edges(spark, d), R, "s5", 1, "callees")
    return g.alternatives(_edges(spark, d), _assertions(spark, d), seen, R)


def code_paths(spark, d):
    out, cut = g.dependency_paths(_nodes(spark, d), _edges(spark, d), R, "s5", "s9", 4)
    return out.crossJoin(F.broadcast(cut)).select(F.array_join("nodes", ">").alias("path"), "hops", "truncated")  # one row


def code_path_evidence(spark, d):
    out, _ = g.dependency_paths(_nodes(spark, d), _edges(spark, d), R, "s5", "s9", 4)
    return g.path_evidence(out, _edges(spark, d), R).select("path", "place", "src", "dst", F.array_join("types", ",").alias("types"), "confidence")


def code_outgoing(spark, d):
    out, cut = g.outgoing(_nodes(spark, d), _edges(spark, d), R, "m3", 60)
    return out.crossJoin(F.broadcast(cut))  # one row


GRAPH = """alive AS (SELECT 's' || p_partkey AS id, 'symbol' AS kind FROM part WHERE p_size <> 1 UNION ALL SELECT 'f' || s_suppkey, 'file' FROM supplier WHERE s_suppkey % 10 <> 9 AND s_suppkey % 7 <> 0
  UNION ALL SELECT DISTINCT 'm' || s_nationkey, 'module' FROM supplier WHERE s_suppkey % 10 <> 9 AND s_suppkey % 7 <> 0 UNION ALL SELECT 'r0', 'repository'),
nx AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS next_part FROM lineitem),
ed AS (SELECT DISTINCT 'DEFINES' AS type, 'f' || l_suppkey AS src, 's' || l_partkey AS dst FROM lineitem WHERE l_linenumber = 1
  UNION SELECT CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'R' THEN 'REFERENCES' ELSE 'IMPORTS' END, 's' || l_partkey, 's' || next_part FROM nx WHERE next_part IS NOT NULL
  UNION SELECT 'IN_MODULE', 'f' || s_suppkey, 'm' || s_nationkey FROM supplier UNION SELECT 'IN_REPOSITORY', 'f' || s_suppkey, 'r0' FROM supplier
  UNION SELECT 'DEPENDS_ON', 'f' || l_suppkey, 'ext:' || l_returnflag FROM lineitem WHERE l_linenumber = 2),
code AS (SELECT * FROM ed WHERE type IN ('CALLS', 'REFERENCES', 'IMPORTS', 'DEFINES')),
hop(from_kind, src, dst) AS (SELECT a.kind, e.src, e.dst FROM (SELECT src, dst FROM code UNION ALL SELECT dst, src FROM code) e JOIN alive a ON a.id = e.src JOIN alive b ON b.id = e.dst WHERE a.kind IN ('file', 'symbol') AND b.kind IN ('file', 'symbol')
  UNION ALL SELECT 'file', e.src, e.dst FROM ed e JOIN alive a ON a.id = e.src JOIN alive b ON b.id = e.dst WHERE e.type = 'IN_MODULE' UNION ALL SELECT 'module', e.dst, e.src FROM ed e JOIN alive a ON a.id = e.src JOIN alive b ON b.id = e.dst WHERE e.type = 'IN_MODULE'
  UNION ALL SELECT 'repository', e.dst, e.src FROM ed e JOIN alive a ON a.id = e.src WHERE e.type = 'IN_REPOSITORY'),
call AS (SELECT e.src, e.dst FROM ed e JOIN alive a ON a.id = e.src JOIN alive b ON b.id = e.dst WHERE e.type = 'CALLS')"""


def _levels(anchor, depth, hops, cap):
    """Level by level, since each depends on what the cap left of the one before."""
    out = [f"l0 AS (SELECT id, kind, 0 AS distance, false AS cut FROM alive WHERE id = '{anchor}')", "s0 AS (FROM l0)"]
    for k in range(1, depth + 1):
        out.append(f"""c{k} AS (SELECT h.dst AS id, min(CASE h.from_kind WHEN 'repository' THEN 0 WHEN 'module' THEN 1 WHEN 'file' THEN 2 ELSE 3 END) AS place FROM ({hops}) h JOIN s{k - 1} s ON s.id = h.src AND s.distance = {k - 1}
  WHERE h.dst NOT IN (SELECT id FROM s{k - 1}) AND NOT (SELECT bool_or(cut) FROM s{k - 1}) GROUP BY h.dst),
n{k} AS (SELECT c.id, a.kind, row_number() OVER (ORDER BY place, c.id) AS rn, count(*) OVER () AS total FROM c{k} c JOIN alive a USING (id)),
l{k} AS (SELECT id, kind, {k} AS distance, total > {cap} - (SELECT count(*) FROM s{k - 1}) AS cut FROM n{k} WHERE rn <= {cap} - (SELECT count(*) FROM s{k - 1})), s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})""")
    return ", ".join(out)


def _walk_sql(anchor, depth, hops, cap=g.NODES):
    return f"WITH {GRAPH}, {_levels(anchor, depth, hops, cap)} SELECT id, kind, CAST(distance AS BIGINT) AS distance, (SELECT bool_or(cut) FROM s{depth}) AS truncated FROM s{depth}"


HOPS, CALLEES, CALLERS = "SELECT * FROM hop", "SELECT 'symbol' AS from_kind, src, dst FROM call", "SELECT 'symbol' AS from_kind, dst AS src, src AS dst FROM call"
EDGES_SQL = f"""WITH {GRAPH}, {_levels('s5', 1, HOPS, g.NODES)}, x AS (SELECT type, src, dst, CASE type WHEN 'CALLS' THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN type = 'CALLS' THEN 'v1,v2' WHEN type IN ('REFERENCES', 'IMPORTS', 'DEFINES') THEN 'v1' ELSE '' END AS revisions
  FROM ed WHERE type <> 'DEPENDS_ON' AND src IN (SELECT id FROM s1) AND dst IN (SELECT id FROM s1))
SELECT *, (SELECT count(*) FROM x) > 2000 AS truncated FROM x ORDER BY type, src, dst LIMIT 2000"""
ALTERNATIVES_SQL = f"""WITH {GRAPH}, {_levels('s5', 1, CALLEES, g.NODES)} SELECT type || '|' || src || '|' || dst || CASE type WHEN 'CALLS' THEN '~weak' ELSE '~old' END AS assertion_id, src AS subject, type AS predicate, dst AS object,
  CASE type WHEN 'CALLS' THEN 'lower_evidence' ELSE 'not_current' END AS reason FROM code WHERE type IN ('CALLS', 'IMPORTS') AND src IN (SELECT id FROM s1)"""
PATH = f"""WITH RECURSIVE {GRAPH}, ln AS (SELECT DISTINCT e.src, e.dst FROM code e JOIN alive a ON a.id = e.src JOIN alive b ON b.id = e.dst WHERE e.src <> e.dst),
w AS (SELECT ['s5'] AS nodes, 's5' AS tail UNION ALL SELECT list_append(nodes, ln.dst), ln.dst FROM w JOIN ln ON ln.src = w.tail WHERE w.tail <> 's9' AND len(nodes) <= 4 AND NOT list_contains(nodes, ln.dst)),
f AS (SELECT nodes, len(nodes) - 1 AS hops, count(*) OVER () AS total, row_number() OVER (ORDER BY len(nodes), nodes) AS rn FROM w WHERE tail = 's9' AND len(nodes) > 1), pa AS (SELECT array_to_string(nodes, '>') AS path, nodes, hops, total > 50 AS truncated FROM f WHERE rn <= 50)"""
PATHS_SQL = f"{PATH} SELECT path, hops, truncated FROM pa"
PATH_EVIDENCE_SQL = f"""{PATH}, st AS (SELECT path, nodes, unnest(range(1, len(nodes))) AS place FROM pa), x AS (SELECT path, place, nodes[place] AS src, nodes[place + 1] AS dst FROM st),
k AS (SELECT src, dst, array_to_string(list_sort(list(DISTINCT type)), ',') AS types, max(CASE type WHEN 'CALLS' THEN 0.5 ELSE 0.9 END)::DOUBLE AS confidence FROM code GROUP BY ALL)
SELECT path, place, src, dst, types, confidence FROM x JOIN k USING (src, dst)"""
OUTGOING_SQL = f"""WITH {GRAPH}, fl AS (SELECT src AS id FROM ed JOIN alive ON id = src WHERE type = 'IN_MODULE' AND dst = 'm3' UNION ALL SELECT 'm3'),
su AS (SELECT DISTINCT id FROM (SELECT id FROM fl UNION SELECT dst FROM ed JOIN fl ON src = fl.id JOIN alive a ON a.id = dst WHERE type = 'DEFINES') ORDER BY id), n AS (SELECT id, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS total FROM su)
SELECT type, src, dst, total > 60 AS truncated FROM ed JOIN n ON n.id = src WHERE rn <= 60 AND type IN ('IMPORTS', 'DEPENDS_ON')"""

QUERIES = {f.__name__: f for f in (code_neighborhood, code_neighborhood_capped, code_callers, code_callees, code_edges, code_alternatives, code_paths, code_path_evidence, code_outgoing)}
ORACLE_SQL = {
    "code_neighborhood": _walk_sql("m3", 3, HOPS), "code_neighborhood_capped": _walk_sql("r0", 2, HOPS, 40), "code_callers": _walk_sql("s5", 2, CALLERS), "code_callees": _walk_sql("s5", 2, CALLEES), "code_edges": EDGES_SQL,
    "code_alternatives": ALTERNATIVES_SQL, "code_paths": PATHS_SQL, "code_path_evidence": PATH_EVIDENCE_SQL, "code_outgoing": OUTGOING_SQL,
}
