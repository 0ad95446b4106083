"""Scalar rules, caps, ranks and lineage over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.functions import scalars as sc
from chronofold.functions.structure import structure
from chronofold.operators import secondary as op
from chronofold.plans.ledger_queries import BOX, EV
from chronofold.sources.ingest import gate
from chronofold.sources.tables import ledger, outbox, table

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def scalar_identity(spark, d):
    p = table(spark, d, "part")
    enc = sc.length_prefixed(F.col("p_name"), F.col("p_brand"), F.col("p_type"))
    return p.select("p_partkey", enc.alias("encoded"), sc.uuid5(NAMESPACE, enc).alias("uuid"), sc.object_key(F.sha2("p_name", 256)).alias("key"))


IDENTITY_SQL = f"""WITH e AS (SELECT p_partkey, p_name, concat_ws(',', strlen(p_name) || ':' || p_name, strlen(p_brand) || ':' || p_brand, strlen(p_type) || ':' || p_type) AS encoded FROM part),
h AS (SELECT *, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(encoded)) AS h, sha256(p_name) AS n FROM e)
SELECT p_partkey, encoded, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT & 3) + 1, 1) || h[18:20] || '-' || h[21:32] AS uuid,
  'sha256/' || n[1:2] || '/' || n[3:4] || '/' || n || '.zst' AS key FROM h"""


def scalar_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return docs.select("doc_id", sc.token_estimate(F.col("text")).alias("tokens"), sc.closed_label(F.col("source"), ["src0", "src1"]).alias("label"), F.array_join(sc.query_tokens(F.col("text"), ["the", "of"]), " ").alias("query"))


TEXT_SQL = """WITH w AS (SELECT doc_id, text, source, list_filter(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[0-9a-zà-öø-ÿ]+'), lambda x: length(x) BETWEEN 2 AND 48 AND x NOT IN ('the', 'of')) AS w FROM documents)
SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, CASE WHEN source IN ('src0', 'src1') THEN source ELSE 'other' END AS label,
  array_to_string((list_filter(w, lambda x, i: list_position(w, x) = i))[1:16], ' ') AS query FROM w"""


def normal_urls(spark, d):
    return table(spark, d, "pages").groupBy(sc.normal_url(F.col("url")).alias("url")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


URLS_SQL = r"""SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), ':(80|443)$', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS url,
  count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1"""


def recency_rank(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return op.recency_rank(o, ["o_custkey"], "o_orderdate").select("o_orderkey", F.round("recency", 9).alias("recency"))


RECENCY_SQL = """WITH t AS (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders))
SELECT o_orderkey, round(CASE WHEN n = 1 THEN 1.0 ELSE (r - 1) / (n - 1) END, 9) AS recency FROM orders JOIN t USING (o_custkey, o_orderdate)"""


def disambiguator_ordinals(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return op.ordinals(p, ["p_brand", "p_type"], ["p_partkey"]).select("p_partkey", "ordinal")


ORDINAL_SQL = "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS ordinal FROM part"


def scan_caps(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return op.scan_caps(docs, "source", "doc_id", F.col("n_chars"), 20, 20_000, 60_000).select("source", "doc_id", "reason")


CAPS_SQL = """WITH c AS (SELECT source, doc_id, n_chars, n_chars <= 20000 AS fits, count(*) FILTER (n_chars <= 20000) OVER w AS n, coalesce(sum(n_chars) FILTER (n_chars <= 20000) OVER w, 0) AS total FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, CASE WHEN NOT fits THEN 'too_large' WHEN n > 20 THEN 'file_cap' WHEN total > 60000 THEN 'byte_cap' END AS reason FROM c"""


def version_cap(spark, d):
    """The newest 200 events by id, without the user that the cut goes through."""
    ev = table(spark, d, "events").select("event_id", "user_id").withColumn("g", F.floor(F.col("event_id") / 7))
    return op.cap_whole_groups(ev, [F.desc("event_id")], "g", 200).select("event_id", "user_id")


CAP_SQL = """WITH n AS (SELECT event_id, user_id, event_id // 7 AS g, row_number() OVER (ORDER BY event_id DESC) AS n FROM events)
SELECT event_id, user_id FROM n WHERE n <= 200 AND g NOT IN (SELECT g FROM n WHERE n = 201)"""


def checkpoint_advance(spark, d):
    return op.checkpoint_advance(outbox(spark, d), ["event_type"])


ADVANCE_SQL = f"WITH {BOX} SELECT event_type, max(outbox_id) AS last_outbox_id, arg_max(event_id, outbox_id) AS last_event_id, count(*) AS processed FROM box WHERE status = 'delivered' GROUP BY event_type"


def delivery_retry(spark, d):
    ev = table(spark, d, "events").select("event_id", (F.col("event_id") % 7 + 1).alias("attempt"))
    return op.delivery_outcome(ev, 5, 250, 2000)


RETRY_SQL = """SELECT event_id, event_id % 7 + 1 AS attempt, CASE WHEN event_id % 7 + 1 >= 5 THEN 'dead_lettered' ELSE 'pending' END AS status,
  CASE WHEN event_id % 7 + 1 < 5 THEN CAST(least(2000.0, 250.0 * pow(2.0, event_id % 7)) AS BIGINT) END AS delay_ms FROM events"""


def run_outcome(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return op.run_outcome(o.select("o_orderkey", (key % 11 == 0).alias("scan_incomplete"), (key % 7 == 0).alias("snapshot_incomplete"), (key % 5 == 0).alias("files_skipped"), (key % 3 == 0).alias("files_degraded"))).select("o_orderkey", "outcome")


OUTCOME_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'scan_incomplete' WHEN o_orderkey % 7 = 0 THEN 'snapshot_incomplete' WHEN o_orderkey % 5 = 0 THEN 'files_skipped' WHEN o_orderkey % 3 = 0 THEN 'files_degraded' END AS outcome FROM orders"""


def rename_resolution(spark, d):
    """Commits are brands; a file's blob is its type and size; even parts are removed, odd ones added."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("commit"), F.col("p_name").alias("path"), F.concat_ws("|", "p_type", "p_size").alias("blob"), F.col("p_partkey").alias("file_id"))
    return op.resolve_renames(p.filter("file_id % 2 = 0"), p.filter("file_id % 2 = 1").drop("file_id"), "commit")


RENAME_SQL = """WITH p AS (SELECT p_brand AS commit, p_name AS path, p_type || '|' || p_size AS blob, p_partkey AS id FROM part), g AS (SELECT commit, blob, count(*) AS n_removed, min(id) AS old_id FROM p WHERE id % 2 = 0 GROUP BY ALL),
a AS (SELECT *, count(*) OVER (PARTITION BY commit, blob) AS n_added FROM p WHERE id % 2 = 1)
SELECT commit, path, CASE WHEN n_removed = 1 AND n_added = 1 THEN 'moved' WHEN n_removed IS NOT NULL THEN 'ambiguous' ELSE 'new' END AS basis, CASE WHEN n_removed = 1 AND n_added = 1 THEN old_id END AS file_id,
  CAST(CASE WHEN n_removed = 1 AND n_added = 1 THEN 1.0 WHEN n_removed IS NOT NULL THEN 0.5 END AS DOUBLE) AS confidence FROM a LEFT JOIN g USING (commit, blob)"""


def hash_chain_build(spark, d):
    ev = ledger(spark, d).select("stream_id", "seq", F.concat_ws("|", "event_type", "event_id").alias("body"))
    return op.hash_chain(ev, "stream_id", "seq", "body")


HASH_CHAIN_SQL = f"""WITH RECURSIVE {EV}, c AS (SELECT stream_id, seq, sha256(event_type || '|' || event_id) AS digest FROM ev WHERE seq = 1
  UNION ALL SELECT ev.stream_id, ev.seq, sha256(c.digest || ev.event_type || '|' || ev.event_id) FROM c JOIN ev ON ev.stream_id = c.stream_id AND ev.seq = c.seq + 1) SELECT * FROM c"""


def kind_resolution(spark, d):
    ids = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    kinds = [("region", table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"))), ("nation", table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))), ("supplier", table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))), ("customer", table(spark, d, "customer").select(F.col("c_custkey").alias("id")))]
    return op.resolve_kind(ids, kinds)


KIND_SQL = """WITH k AS (SELECT r_regionkey AS id, 0 AS k, 'region' AS kind FROM region UNION ALL SELECT n_nationkey, 1, 'nation' FROM nation UNION ALL SELECT s_suppkey, 2, 'supplier' FROM supplier UNION ALL SELECT c_custkey, 3, 'customer' FROM customer)
SELECT CAST(id AS BIGINT) AS id, arg_min(kind, k) AS kind FROM k WHERE id IN (SELECT l_partkey FROM lineitem) GROUP BY id"""


def python_structure(spark, d):
    """Sources made from parts: one class and one function each; every symbol, reference and diagnostic comes back."""
    name = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")
    source = F.concat(F.lit("import os\nclass C"), name, F.lit("(Base):\n    def m(self):\n        return os.getcwd()\nLIMIT = "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 9 == 0, F.lit("\n)")).otherwise(F.lit("\n")))
    files = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), source.alias("source"))
    return structure(files).select("path", "record", "kind", "name", "start_line")


STRUCTURE_SQL = """WITH s AS (SELECT 'p' || p_partkey || '.py' AS path, 'C' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS c, p_partkey % 9 = 0 AS bad FROM part),
r(record, kind, name, start_line) AS (VALUES ('reference', 'imports', 'os', 1), ('symbol', 'class', '@', 2), ('reference', 'inherits', 'Base', 2), ('symbol', 'method', '@.m', 3), ('reference', 'calls', 'os.getcwd', 4), ('symbol', 'constant', 'LIMIT', 5))
SELECT path, record, kind, replace(name, '@', c) AS name, CAST(start_line AS BIGINT) AS start_line FROM s, r WHERE NOT bad UNION ALL SELECT path, 'diagnostic', 'SyntaxError', '', 6 FROM s WHERE bad"""

def ingest_batches(spark, d):
    """Events as JSON lines in batches of 20; some are cut, some of an unknown type, some repeat a key."""
    ev = ledger(spark, d)
    kind = F.when(F.col("event_id") % 53 == 0, "mystery").otherwise(F.col("event_type"))
    key = F.when(F.col("event_id") % 41 == 1, F.col("event_id") - 1).otherwise(F.col("event_id")).cast("string")
    body = F.when(F.col("event_id") % 61 == 0, F.expr("left(body, 20)")).when(F.col("event_id") % 67 == 0, F.rpad("body", 5000, " ")).otherwise(F.col("body"))
    raw = ev.withColumn("body", F.to_json(F.struct(F.floor(F.col("event_id") / 20).alias("batch_id"), F.lit("p").alias("producer_id"), key.alias("idempotency_key"), kind.alias("event_type"), "value")))
    return gate(raw.select("event_id", body.alias("body"))).select("event_id", F.coalesce("reason", F.lit("accepted")).alias("outcome"))


INGEST_SQL = """WITH r AS (SELECT event_id, event_id // 20 AS b, CASE WHEN event_id % 41 = 1 THEN event_id - 1 ELSE event_id END AS k,
  CASE WHEN event_id % 61 = 0 THEN 'malformed' WHEN event_id % 67 = 0 THEN 'too_large' WHEN event_id % 53 = 0 THEN 'unknown_type' END AS reason FROM events),
t AS (SELECT *, reason IS NULL AND count(*) FILTER (reason IS NULL) OVER (PARTITION BY b, k) > 1 AS twice FROM r)
SELECT event_id, CASE WHEN twice THEN 'duplicate_key' WHEN reason IS NULL AND bool_or(twice) OVER (PARTITION BY b) THEN 'batch_rejected' ELSE coalesce(reason, 'accepted') END AS outcome FROM t"""


def binding_as_of(spark, d):
    """Each use (purchase) with the latest binding (signup or view) of its user strictly before it."""
    return op.latest_before(ledger(spark, d).withColumn("binds", F.col("event_type").isin("signup", "view")), ["user_id"], ["occurred_at", "event_id"], "binds", "event_id").filter("event_type = 'purchase'").select("event_id", "bound_to")


BINDING_SQL = f"""WITH {EV}, b AS (SELECT event_id, event_type, last_value(CASE WHEN event_type IN ('signup', 'view') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound_to FROM ev)
SELECT event_id, bound_to FROM b WHERE event_type = 'purchase'"""


def git_blob_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", sc.git_blob_id(F.encode("text", "UTF-8")).alias("blob"))


BLOB_SQL = "SELECT doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS blob FROM documents"


def snapshot_ids(spark, d):
    """A checkout-independent digest of each source's dirty entries (path, state, digest)."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 2 == 0, "modified").otherwise("untracked").alias("state"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return op.snapshot_id(docs, ["source"], ["doc_id", "state", "digest"])


SNAPSHOT_SQL = """WITH h AS (SELECT source, sha256(doc_id || '|' || CASE WHEN doc_id % 2 = 0 THEN 'modified' ELSE 'untracked' END || '|' || sha256(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT source, h[1:3] AS b, sha256(string_agg(h, '' ORDER BY h)) AS bh, count(*) AS n FROM h GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(bh, '' ORDER BY b)) AS snapshot_id FROM b GROUP BY source"""


def diagnostics_counters(spark, d):
    return ledger(spark, d).groupBy("event_type", "k").agg(F.least(F.count("*"), F.lit(10)).alias("n"))


COUNTERS_SQL = f"WITH {EV} SELECT event_type, k, least(count(*), 10) AS n FROM ev GROUP BY ALL"


def provisional_commit(spark, d):
    """Provisional files against committed ones by path: the same blob 1.0, another blob 0.5; paths without a match go."""
    p = table(spark, d, "part").select("p_brand", "p_size", "p_type", "p_partkey")
    left = p.filter("p_partkey % 2 = 0").groupBy("p_brand", "p_size").agg(F.min("p_type").alias("blob"))
    right = p.filter("p_partkey % 2 = 1").groupBy("p_brand", "p_size").agg(F.min("p_type").alias("committed"))
    return left.join(right, ["p_brand", "p_size"]).select("p_brand", "p_size", F.when(F.col("blob") == F.col("committed"), 1.0).otherwise(0.5).alias("confidence"))


PROVISIONAL_SQL = """WITH l AS (SELECT p_brand, p_size, min(p_type) AS b FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), r AS (SELECT p_brand, p_size, min(p_type) AS c FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL)
SELECT p_brand, p_size, CAST(CASE WHEN b = c THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM l JOIN r USING (p_brand, p_size)"""

QUERIES = {f.__name__: f for f in (ingest_batches, binding_as_of, git_blob_ids, snapshot_ids, diagnostics_counters, provisional_commit, scalar_identity, scalar_text, normal_urls, recency_rank, disambiguator_ordinals, scan_caps, version_cap, checkpoint_advance, delivery_retry, run_outcome, rename_resolution, hash_chain_build, kind_resolution, python_structure)}
ORACLE_SQL = {
    "ingest_batches": INGEST_SQL, "binding_as_of": BINDING_SQL, "git_blob_ids": BLOB_SQL, "snapshot_ids": SNAPSHOT_SQL, "diagnostics_counters": COUNTERS_SQL, "provisional_commit": PROVISIONAL_SQL,
    "scalar_identity": IDENTITY_SQL, "scalar_text": TEXT_SQL, "normal_urls": URLS_SQL, "recency_rank": RECENCY_SQL, "disambiguator_ordinals": ORDINAL_SQL, "scan_caps": CAPS_SQL, "version_cap": CAP_SQL,
    "checkpoint_advance": ADVANCE_SQL, "delivery_retry": RETRY_SQL, "run_outcome": OUTCOME_SQL, "rename_resolution": RENAME_SQL, "hash_chain_build": HASH_CHAIN_SQL, "kind_resolution": KIND_SQL, "python_structure": STRUCTURE_SQL,
}
