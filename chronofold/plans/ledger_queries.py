"""Ledger, delivery and fold queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import ledger_ops as ops
from chronofold.operators import merge
from chronofold.operators.secondary import set_digest
from chronofold.sources.tables import ledger, outbox, table

EV = """ev AS (SELECT event_id, user_id, 'u' || user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts AS occurred_at,
  ts + to_hours(event_id % 5) AS observed_at, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
BOX = """box AS (SELECT event_id + 1 AS outbox_id, event_id, event_type, ts AS occurred_at, ts + to_hours(event_id % 5) AS observed_at,
  CASE WHEN event_id % 97 = 0 THEN 'dead_lettered' WHEN event_id * 100 >= (SELECT max(event_id) FROM events) * 98 THEN 'pending' ELSE 'delivered' END AS status
  FROM events WHERE event_id % 89 <> 0)"""


def session_fold(spark, d):
    return ops.session_fold(ledger(spark, d))


SESSION_SQL = f"""WITH {EV} SELECT stream_id, min(occurred_at) AS started_at, max(occurred_at) AS last_at,
  CASE max(CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) WHEN 2 THEN 'completed' WHEN 1 THEN 'output_observed' ELSE 'started' END AS status,
  last(event_type ORDER BY occurred_at, event_id) AS head_type, last(value ORDER BY occurred_at, event_id) AS head_value, last(event_id ORDER BY occurred_at, event_id) AS head_id,
  min(value) AS min_value, count(*) AS n_events FROM ev GROUP BY stream_id"""


def turn_fold(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.array_join(merge.provenance("turn"), ",").alias("turns"),
        F.max_by("role", "turn").alias("last_role"), F.count_if(F.col("role") == "assistant").alias("n_answers"),
    )


TURN_SQL = """SELECT conv_id, count(*) AS n_turns, array_to_string(list_sort(list_distinct(list(turn))), ',') AS turns,
  last(role ORDER BY turn) AS last_role, count(*) FILTER (role = 'assistant') AS n_answers FROM conversations GROUP BY conv_id"""


def idempotent_append(spark, d):
    ev = ledger(spark, d)
    out = ops.classify_append(ev, ["user_id", "k"], ["event_type"], "event_id", F.floor(F.col("event_id") / 20))
    return out.select("event_id", "batch", "outcome")


APPEND_SQL = f"""WITH {EV}, c AS (SELECT event_id, event_id // 20 AS batch, CASE WHEN row_number() OVER w = 1 THEN 'created'
  WHEN event_type IS NOT DISTINCT FROM first_value(event_type) OVER w THEN 'existing' ELSE 'conflict' END AS o FROM ev WINDOW w AS (PARTITION BY user_id, k ORDER BY event_id))
SELECT event_id, batch, CASE WHEN o = 'created' AND bool_or(o = 'conflict') OVER (PARTITION BY batch) THEN 'batch_rejected' ELSE o END AS outcome FROM c"""


def stream_sequence(spark, d):
    return ledger(spark, d).select("event_id", "stream_id", "seq", "observed_at")


SEQUENCE_SQL = f"WITH {EV} SELECT event_id, stream_id, seq, observed_at FROM ev"


def stream_heads(spark, d):
    return ops.stream_heads(ledger(spark, d))


HEADS_SQL = f"WITH {EV} SELECT stream_id, max(seq) AS last_seq, last(event_id ORDER BY seq) AS last_event_id FROM ev GROUP BY stream_id"


def _stored(spark, d):
    from pyspark.sql import Window

    ev = ledger(spark, d).withColumn("digest", F.sha2(F.concat_ws("|", "stream_id", "seq", "event_type", "event_id"), 256))
    link = F.lag("digest").over(Window.partitionBy("stream_id").orderBy("seq"))
    return ev.withColumn("stored_link", F.when(F.col("event_id") % 101 == 0, "bad").otherwise(link)).withColumn("stored_seq", F.when(F.col("event_id") % 211 == 0, F.col("seq") + 1).otherwise(F.col("seq")))


def chain_verify(spark, d):
    return ops.verify_chain(_stored(spark, d))


CHAIN_SQL = f"""WITH {EV}, h AS (SELECT *, sha256(stream_id || '|' || seq || '|' || event_type || '|' || event_id) AS digest FROM ev),
s AS (SELECT *, CASE WHEN event_id % 101 = 0 THEN 'bad' ELSE lag(digest) OVER w END AS stored_link, CASE WHEN event_id % 211 = 0 THEN seq + 1 ELSE seq END AS stored_seq FROM h WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
c AS (SELECT stream_id, seq, CASE WHEN stored_seq <> coalesce(lag(stored_seq) OVER w + 1, 1) THEN 'sequence' WHEN stored_link IS DISTINCT FROM lag(digest) OVER w THEN 'link' END AS chk FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY seq))
SELECT stream_id, arg_min(chk, seq) AS first_check, min(seq) AS at_seq, count(*) AS n_failed FROM c WHERE chk IS NOT NULL GROUP BY stream_id"""


def event_type_stats(spark, d):
    return ops.event_type_stats(table(spark, d, "events"), outbox(spark, d))


STATS_SQL = f"""WITH {BOX} SELECT e.event_type, count(*) AS total, count(*) FILTER (outbox_id IS NULL) AS unqueued, count(*) FILTER (status = 'delivered') AS delivered,
  count(*) FILTER (status = 'dead_lettered') AS dead, count(*) FILTER (status = 'pending') AS pending, min(outbox_id) AS min_outbox, max(outbox_id) AS max_outbox
FROM events e LEFT JOIN box USING (event_id) GROUP BY e.event_type"""


def watermark_freshness(spark, d):
    return ops.freshness(outbox(spark, d))


FRESH_SQL = f"""WITH {BOX}, o AS (SELECT min(outbox_id) FILTER (status = 'pending') AS oldest_waiting FROM box),
m AS (SELECT max(outbox_id) AS watermark FROM box, o WHERE status = 'delivered' AND (oldest_waiting IS NULL OR outbox_id < oldest_waiting)),
v AS (SELECT max(least(observed_at, occurred_at)) AS valid_instant FROM (SELECT * FROM box, m WHERE status = 'delivered' AND outbox_id <= watermark ORDER BY outbox_id DESC LIMIT 1000)),
k AS (SELECT min(observed_at) - INTERVAL 1 MICROSECOND AS known_until FROM box, m WHERE event_type IN ('error', 'purchase') AND outbox_id > watermark)
SELECT oldest_waiting, watermark, valid_instant, known_until, least(valid_instant, known_until) AS effective_at FROM o, m, v, k"""


def dead_letter_status(spark, d):
    return outbox(spark, d).groupBy("event_type", "status").agg(F.count("*").alias("n"), F.max_by("event_id", "outbox_id").alias("last_event"))


DEAD_SQL = f"WITH {BOX} SELECT event_type, status, count(*) AS n, arg_max(event_id, outbox_id) AS last_event FROM box GROUP BY ALL"


def stream_head_check(spark, d):
    ev = ledger(spark, d)
    heads = ops.stream_heads(ev)
    uid = F.substring("stream_id", 2, 20).cast("long")
    stored = heads.withColumn("last_seq", F.when(uid % 7 == 0, F.col("last_seq") + 1).otherwise(F.col("last_seq"))).withColumn("last_event_id", F.when(uid % 11 != 0, F.col("last_event_id")))
    return ops.head_mismatch(stored, heads)


HEAD_CHECK_SQL = f"""WITH {EV}, h AS (SELECT stream_id, any_value(user_id) AS u, max(seq) AS s, arg_max(event_id, seq) AS e FROM ev GROUP BY stream_id)
SELECT stream_id, CASE WHEN u % 7 = 0 THEN s + 1 ELSE s END AS stored_seq, s AS newest_seq FROM h WHERE u % 7 = 0 OR u % 11 = 0"""


def orphan_provenance(spark, d):
    ev = table(spark, d, "events").select("event_id")
    items = ev.select(F.array(F.col("event_id"), F.col("event_id") * 2).alias("sources"))
    return ops.orphans(items, "sources", ev)


ORPHAN_SQL = """WITH i AS (SELECT unnest([event_id, event_id * 2]) AS source_id FROM events)
SELECT source_id, count(*) AS n_items FROM i WHERE source_id NOT IN (SELECT event_id FROM events) GROUP BY source_id"""


def search_document_fold(spark, d):
    """Several events name one content: earliest attributes, united provenance; groups whose scopes disagree are refused."""
    docs = table(spark, d, "documents").select((F.col("doc_id") % 300).alias("content_id"), "doc_id", "lang", "source")
    return docs.groupBy("content_id").agg(
        F.min_by(F.struct("lang", "source"), "doc_id").alias("a"), F.array_join(merge.provenance("doc_id"), ",").alias("sources"),
        (F.min("lang") != F.max("lang")).alias("refused"),
    ).select("content_id", "a.lang", "a.source", "sources", "refused")


SEARCH_FOLD_SQL = """SELECT doc_id % 300 AS content_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source,
  array_to_string(list_sort(list_distinct(list(doc_id))), ',') AS sources, min(lang) <> max(lang) AS refused FROM documents GROUP BY doc_id % 300"""


def content_store(spark, d):
    """Content addressed by digest; identical bytes are one object, small ones inline."""
    docs = table(spark, d, "documents").select(F.col("text").alias("body"), F.col("doc_id").alias("id"))
    pages = table(spark, d, "pages").select(F.col("html").alias("body"), (-F.col("page_id") - 1).alias("id"))
    key = F.sha2("body", 256)
    return docs.unionByName(pages).filter("body is not null").groupBy(key.alias("digest")).agg(F.count("*").alias("n_refs"), F.min("id").alias("first_id"), F.max(F.octet_length("body")).cast("long").alias("bytes")).withColumn(
        "object_key", F.when(F.col("bytes") > 4096, F.concat(F.lit("sha256/"), F.substring("digest", 1, 2), F.lit("/"), F.substring("digest", 3, 2), F.lit("/"), F.col("digest"), F.lit(".zst")))
    )


CONTENT_SQL = """WITH b AS (SELECT text AS body, doc_id AS id FROM documents UNION ALL SELECT html, -page_id - 1 FROM pages)
SELECT sha256(body) AS digest, count(*) AS n_refs, min(id) AS first_id, max(strlen(body)) AS bytes,
  CASE WHEN max(strlen(body)) > 4096 THEN 'sha256/' || sha256(body)[1:2] || '/' || sha256(body)[3:4] || '/' || sha256(body) || '.zst' END AS object_key
FROM b WHERE body IS NOT NULL GROUP BY sha256(body)"""


def orphan_blobs(spark, d):
    """Stored digests of pages that no page of an even id refers to any more."""
    pages = table(spark, d, "pages").filter("html is not null").select("page_id", F.sha2("html", 256).alias("digest"))
    return pages.select("digest").distinct().join(pages.filter("page_id % 2 = 0").select("digest"), "digest", "left_anti")


ORPHAN_BLOB_SQL = """SELECT DISTINCT sha256(html) AS digest FROM pages WHERE html IS NOT NULL AND sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 2 = 0 AND html IS NOT NULL)"""


def purge_tombstones(spark, d):
    """A purge hides its content whatever the order; the earliest purge of a content is its tombstone."""
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 300).alias("content_id"))
    stones = docs.filter("doc_id % 7 = 0").groupBy("content_id").agg(F.min("doc_id").alias("purged_by"))
    live = docs.join(stones, "content_id", "left_anti").groupBy("content_id").agg(F.count("*").alias("n"))
    return live.select("content_id", "n", F.lit(None).cast("long").alias("purged_by")).unionByName(stones.select("content_id", F.lit(0).cast("long").alias("n"), "purged_by"))


PURGE_SQL = """WITH c AS (SELECT doc_id, doc_id % 300 AS content_id FROM documents), s AS (SELECT content_id, min(doc_id) AS purged_by FROM c WHERE doc_id % 7 = 0 GROUP BY content_id)
SELECT content_id, count(*) AS n, CAST(NULL AS BIGINT) AS purged_by FROM c WHERE content_id NOT IN (SELECT content_id FROM s) GROUP BY content_id UNION ALL SELECT content_id, 0, purged_by FROM s"""


def graph_digest(spark, d):
    """A digest for every label, independent of row order: hashes in 4,096 buckets by their first digits, then the buckets' digests.

    No task or row holds more than a bucket's hashes.
    """
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("label"), F.concat_ws("|", "s_suppkey", "s_name", "s_nationkey").alias("row"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("label"), F.concat_ws("|", "c_custkey", "c_name", "c_nationkey").alias("row"))
    return set_digest(s.unionByName(c), ["label"], F.col("row"), "digest")


DIGEST_SQL = """WITH h AS (SELECT 'supplier' AS label, sha256(s_suppkey || '|' || s_name || '|' || s_nationkey) AS h FROM supplier
  UNION ALL SELECT 'customer', sha256(c_custkey || '|' || c_name || '|' || c_nationkey) FROM customer),
b AS (SELECT label, h[1:3] AS b, sha256(string_agg(h, '' ORDER BY h)) AS bh, count(*) AS n FROM h GROUP BY ALL)
SELECT label, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(bh, '' ORDER BY b)) AS digest FROM b GROUP BY label"""


def catalog_scope(spark, d):
    r, n, s = (table(spark, d, x) for x in ("region", "nation", "supplier"))
    return r.join(n, r.r_regionkey == n.n_regionkey).join(s, n.n_nationkey == s.s_nationkey).select("r_name", "n_name", "s_suppkey", "s_name")


SCOPE_SQL = "SELECT r_name, n_name, s_suppkey, s_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey"


def module_rollup(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "lang", "n_chars")
    tops = F.slice(F.array_sort(F.collect_list("doc_id")), 1, 10)
    # the ten smallest ids of each source come from a bounded per-group top ten, not from whole lists
    from pyspark.sql import Window

    first = docs.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("r <= 10")
    lists = first.groupBy("source").agg(F.array_join(tops, ",").alias("first_ids"))
    return docs.groupBy("source").agg(F.count("*").alias("n_files"), F.count_distinct("lang").alias("n_langs"), F.sum("n_chars").alias("chars")).join(lists, "source")


ROLLUP_SQL = """SELECT source, count(*) AS n_files, count(DISTINCT lang) AS n_langs, CAST(sum(n_chars) AS BIGINT) AS chars, array_to_string(list_sort(list(doc_id))[1:10], ',') AS first_ids FROM documents GROUP BY source"""

QUERIES = {f.__name__: f for f in (session_fold, turn_fold, idempotent_append, stream_sequence, stream_heads, chain_verify, event_type_stats, watermark_freshness, dead_letter_status, stream_head_check, orphan_provenance, search_document_fold, content_store, orphan_blobs, purge_tombstones, graph_digest, catalog_scope, module_rollup)}
ORACLE_SQL = {
    "session_fold": SESSION_SQL, "turn_fold": TURN_SQL, "idempotent_append": APPEND_SQL, "stream_sequence": SEQUENCE_SQL, "stream_heads": HEADS_SQL, "chain_verify": CHAIN_SQL,
    "event_type_stats": STATS_SQL, "watermark_freshness": FRESH_SQL, "dead_letter_status": DEAD_SQL, "stream_head_check": HEAD_CHECK_SQL, "orphan_provenance": ORPHAN_SQL,
    "search_document_fold": SEARCH_FOLD_SQL, "content_store": CONTENT_SQL, "orphan_blobs": ORPHAN_BLOB_SQL, "purge_tombstones": PURGE_SQL, "graph_digest": DIGEST_SQL, "catalog_scope": SCOPE_SQL, "module_rollup": ROLLUP_SQL,
}
