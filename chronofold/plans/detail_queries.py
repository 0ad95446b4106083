"""Small rules over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import details as dt
from chronofold.plans import ledger_queries
from chronofold.sources.tables import table


def catalog_upsert(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("project"), F.col("o_orderdate").alias("seen"))
    return dt.catalog_upsert(o.filter("o_custkey % 2 = 0"), o.filter("o_custkey % 3 = 0"), ["o_custkey", "project"], "seen")


UPSERT_SQL = "SELECT o_custkey, o_orderpriority AS project, max(o_orderdate) AS seen FROM orders WHERE o_custkey % 2 = 0 OR o_custkey % 3 = 0 GROUP BY ALL"


def scoped_rows(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 5 != 0, (F.col("user_id") % 3).cast("string")).alias("project_id"), F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 4).cast("string")).alias("repository_id"))
    scopes = [("both", "1", "2"), ("project", "1", None), ("repository", None, "2")]
    out = None
    for name, p, r in scopes:
        one = e.filter(dt.in_scope(p, r)).agg(F.count("*").alias("n"), F.min("event_id").alias("first")).withColumn("scope", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


SCOPED_SQL = """WITH e AS (SELECT event_id, user_id % 5 <> 0 AND user_id % 3 = 1 AS p, event_id % 7 <> 0 AND event_id % 4 = 2 AS r FROM events)
SELECT 'both' AS scope, count(*) AS n, min(event_id) AS first FROM e WHERE p AND r UNION ALL SELECT 'project', count(*), min(event_id) FROM e WHERE p UNION ALL SELECT 'repository', count(*), min(event_id) FROM e WHERE r"""


def citable_content(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("content_id"), F.when(F.col("l_returnflag") == "A", "withheld").otherwise("sanitized").alias("disposition"))
    return dt.citable(refs, table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("content_id")))


CITABLE_SQL = "SELECT l_orderkey AS event_id, min(l_partkey) AS content_id FROM lineitem WHERE l_returnflag <> 'A' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY 1"


def dirty_runs(spark, d):
    line = table(spark, d, "lineitem")
    runs = line.groupBy(F.col("l_orderkey").alias("failure_id")).agg(F.array_sort(F.collect_set(F.struct(F.col("l_linenumber").alias("run_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("snapshot_id")))).alias("runs"))
    out = dt.without_dirty_runs(runs.withColumn("resolution", F.lit("resolved")), "A")
    return out.select("failure_id", F.array_join(F.transform("runs", lambda r: r["run_id"].cast("string")), ",").alias("runs"), "resolution")


DIRTY_SQL = """WITH r AS (SELECT DISTINCT l_orderkey AS failure_id, l_linenumber AS n, l_returnflag AS f FROM lineitem)
SELECT failure_id, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n, CASE f WHEN 'N' THEN 0 ELSE 1 END) FILTER (f <> 'R'), '') AS runs, CASE WHEN count(*) FILTER (f = 'R') = 0 THEN 'resolved' END AS resolution FROM r GROUP BY failure_id"""


def property_graph_digest(spark, d):
    props = lambda **k: F.map_from_arrays(F.array(*[F.lit(x) for x in [*k, "_lock"]]), F.array(*[F.col(c).cast("string") for c in k.values()], F.uuid()))
    c, s, n = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    nodes = c.select(F.lit("Customer").alias("label"), F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey").cast("string")).alias("id"), props(segment="c_mktsegment", name="c_name").alias("props"))
    nodes = nodes.unionByName(s.select(F.lit("Supplier").alias("label"), F.col("s_suppkey").cast("string").alias("id"), props(name="s_name").alias("props")))
    edges = n.select(F.lit("IN_REGION").alias("type"), F.col("n_name").alias("src"), F.col("n_regionkey").cast("string").alias("dst"), props(key="n_nationkey").alias("props"))
    return dt.property_graph_digest(nodes, edges)


GRAPH_SQL = """WITH j AS (SELECT 'Customer' AS label, CASE WHEN c_custkey % 50 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS id, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS p FROM customer UNION ALL SELECT 'Supplier', CAST(s_suppkey AS VARCHAR), '{"name":"' || s_name || '"}' FROM supplier),
l AS (SELECT label, 'n' || chr(1) || coalesce(id, sha256(p)) || chr(1) || p AS line, id IS NULL AS u FROM j UNION ALL SELECT 'IN_REGION', 'r' || chr(1) || n_name || chr(1) || n_regionkey || chr(1) || '{"key":"' || n_nationkey || '"}', false FROM nation),
h AS (SELECT label, u, sha256(line) AS h FROM l), b AS (SELECT label, h[1:3] AS b, sha256(string_agg(h, '' ORDER BY h)) AS bh, count(*) AS n, count(*) FILTER (u) AS k FROM h GROUP BY ALL)
SELECT label, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(bh, '' ORDER BY b)) AS digest, CAST(sum(k) AS BIGINT) AS n_unnamed FROM b GROUP BY label"""


def evidence_precedence(spark, d):
    line = table(spark, d, "lineitem").filter("l_linenumber <= 2")
    kind = lambda c: F.array(*[F.lit(k) for k in [*dt.PRECEDENCE, "guess"]])[(F.col(c) % 5).cast("int")]
    won = dt.outranks(kind("l_partkey"), F.col("l_discount"), kind("l_suppkey"), F.col("l_tax"))
    return line.groupBy(won.alias("outranks"), kind("l_partkey").alias("kind")).agg(F.count("*").alias("n"))


PRECEDENCE_SQL = """WITH x AS (SELECT CASE WHEN l_partkey % 5 = 4 THEN -1 ELSE l_partkey % 5 END AS a, CASE WHEN l_suppkey % 5 = 4 THEN -1 ELSE l_suppkey % 5 END AS b, l_discount, l_tax, ['llm_inference', 'agent', 'tree_sitter', 'scip', 'guess'][l_partkey % 5 + 1] AS kind FROM lineitem WHERE l_linenumber <= 2)
SELECT a > b OR (a = b AND l_discount > l_tax) AS outranks, kind, count(*) AS n FROM x GROUP BY ALL"""


def source_names(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("item_id"), F.when(F.col("event_id") % 2 == 0, F.regexp_replace(F.md5(F.col("user_id").cast("string")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")).alias("first"), F.array(F.col("event_type"), F.lit(None).cast("string")).alias("rest"))
    return dt.named_sources(e, ["first", "rest"]).groupBy("source_id", "well_formed").agg(F.count("*").alias("n"))


SOURCES_SQL = """WITH x AS (SELECT md5(CAST(user_id AS VARCHAR)) AS m, event_type, event_id FROM events)
SELECT m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS source_id, true AS well_formed, count(*) AS n FROM x WHERE event_id % 2 = 0 GROUP BY ALL UNION ALL SELECT event_type, false, count(*) FROM x GROUP BY ALL"""


def scan_leaves(spark, d):
    p = table(spark, d, "pages")
    i = F.col("page_id")
    data = F.when(i % 11 != 0, F.encode(F.when(i % 7 == 0, F.concat(F.lit("a\0"), "html")).otherwise(F.col("html")), "UTF-8"))
    rows = p.select(i.cast("string").alias("path"), F.when(i % 5 == 0, "link").otherwise("file").alias("kind"), data.alias("data"), F.when(i % 10 == 0, "../up").otherwise("ok/..b").alias("target"))
    return dt.leaves(rows, F.lit("root"), 1500)


LEAVES_SQL = """WITH x AS (SELECT page_id AS i, CASE WHEN page_id % 5 = 0 THEN 'link' ELSE 'file' END AS kind, CASE WHEN page_id % 11 <> 0 THEN CASE WHEN page_id % 7 = 0 THEN '61'||'00' ELSE '' END || hex(encode(html)) END AS hx FROM pages),
y AS (SELECT *, CASE WHEN kind = 'file' AND hx IS NULL THEN 'missing' WHEN kind = 'link' AND i % 10 = 0 THEN 'escapes' WHEN kind = 'file' AND length(hx) // 2 > 1500 THEN 'too_large' END AS skip FROM x), z AS (SELECT *, skip IS NULL AND kind = 'file' AS ok FROM y)
SELECT 'root/' || i AS path, kind, skip, CASE WHEN ok THEN length(hx) // 2 END AS size, CASE WHEN ok THEN sha256(unhex(hx)) END AS digest, CASE WHEN ok THEN sha1(encode('blob ' || (length(hx) // 2)) || '\\x00'::BLOB || unhex(hx)) END AS blob, CASE WHEN ok THEN i % 7 = 0 END AS "binary" FROM z"""


def gitlink_changes(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_type").alias("oid"))
    return dt.gitlink_changes(p.filter("path % 3 <> 0"), p.filter("path % 5 <> 0").withColumn("oid", F.when(F.col("path") % 7 == 0, "moved").otherwise(F.col("oid"))))


GITLINK_SQL = """SELECT * FROM (SELECT p_partkey AS path, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS head_oid, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'moved' ELSE p_type END AS index_oid FROM part) WHERE head_oid IS DISTINCT FROM index_oid"""


def sealed_references(spark, d):
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.array_sort(F.collect_set(F.struct(F.col("l_partkey").alias("content_id"), F.when(F.col("l_partkey") % 2 == 0, "inline").otherwise("object").alias("storage")))).alias("content_refs"))
    return dt.sealed_rows(line)[1]


SEALED_SQL = "SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY content_id) - 1 AS place, content_id, CASE WHEN content_id % 2 = 0 THEN 'inline' ELSE 'object' END AS storage FROM (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS content_id FROM lineitem)"


def item_references(spark, d):
    line = table(spark, d, "lineitem")
    cited = line.select(
        F.col("l_suppkey").alias("item_id"), (F.col("l_orderkey") % 40).cast("string").alias("event_id"), F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).alias("content_id"), F.lit("Text/Plain; x").alias("media_type"),
        F.col("l_shipdate").alias("valid_from"), F.col("l_shipdate").alias("valid_to"), (F.col("l_discount") * 11).alias("confidence"),
    )
    return dt.shown_references(dt.references(cited, "ledger://"))


ITEM_SQL = """WITH u AS (SELECT DISTINCT l_suppkey AS item_id, 'ledger://events/' || (l_orderkey % 40) || CASE WHEN l_linenumber = 1 THEN '/contents/' || sha256(l_returnflag) ELSE '' END AS uri FROM lineitem WHERE l_discount * 11 BETWEEN 0 AND 1),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY uri) AS r, count(*) OVER (PARTITION BY item_id) AS n FROM u) SELECT item_id, string_agg(uri, ' ' ORDER BY uri) AS uris, max(n) AS n FROM p WHERE r <= 8 GROUP BY item_id"""


def ingest_retry(spark, d):
    return dt.retry_batches(ledger_queries.idempotent_append(spark, d))


RETRY_SQL = f"SELECT batch, event_id FROM ({ledger_queries.APPEND_SQL}) WHERE outcome = 'batch_rejected'"


def report_keys(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", dt.report_key(F.col("n_name"), F.lit("1"), F.col("n_regionkey").cast("string"), F.lit("ok")).alias("key"))


REPORT_SQL = "SELECT n_nationkey, 'report-' || sha256(strlen(n_name) || ':' || n_name || '1:1' || strlen(n_regionkey::VARCHAR) || ':' || n_regionkey || '2:ok')[1:40] AS key FROM nation"


def newest_runs(spark, d):
    return dt.newest_runs(table(spark, d, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("at")), 5)


NEWEST_SQL = """SELECT o_custkey AS scope, o_orderkey AS run, o_orderdate AS "at" FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5"""

QUERIES = {f.__name__: f for f in (catalog_upsert, scoped_rows, citable_content, dirty_runs, property_graph_digest, evidence_precedence, source_names, scan_leaves, gitlink_changes, sealed_references, item_references, ingest_retry, report_keys, newest_runs)}
ORACLE_SQL = {
    "catalog_upsert": UPSERT_SQL, "scoped_rows": SCOPED_SQL, "citable_content": CITABLE_SQL, "dirty_runs": DIRTY_SQL, "property_graph_digest": GRAPH_SQL, "evidence_precedence": PRECEDENCE_SQL, "source_names": SOURCES_SQL, "scan_leaves": LEAVES_SQL, "gitlink_changes": GITLINK_SQL,
    "sealed_references": SEALED_SQL, "item_references": ITEM_SQL, "ingest_retry": RETRY_SQL, "report_keys": REPORT_SQL, "newest_runs": NEWEST_SQL,
}
