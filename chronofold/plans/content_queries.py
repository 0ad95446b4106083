"""Content, search documents and evidence over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import contents as ct
from chronofold.operators import evidence
from chronofold.plans.ledger_queries import BOX
from chronofold.sources.tables import outbox, table

NOW = "2024-01-15 00:00:00"
MEDIA = ["text/plain", "Text/Plain; charset=utf-8", "application/json", "image/png"]


def _bodies(spark, d):
    return table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("content_id"), F.encode("text", "UTF-8").alias("data"), F.lit("text/plain").alias("media_type"))


def _claims(spark, d):
    """Each document is claimed by one event in batches of ten; some claims are wrong in one way."""
    t = table(spark, d, "documents").filter("text is not null")
    i = F.col("doc_id")
    return t.select(
        F.floor(i / 10).alias("batch"), F.when(i % 101 == 0, -i - 1).otherwise(i).alias("content_id"), F.when(i % 103 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("digest"),
        F.when(i % 107 == 0, 1).otherwise(F.octet_length("text")).cast("long").alias("n_bytes"), F.when(i % 109 == 0, "text/html").otherwise("text/plain").alias("media_type"),
    )


def content_prepare(spark, d):
    return ct.prepare(_claims(spark, d), _bodies(spark, d)).select("content_id", "batch", "fault", "accepted")


PREPARE_SQL = """WITH c AS (SELECT doc_id // 10 AS batch, CASE WHEN doc_id % 101 = 0 THEN -doc_id - 1 ELSE doc_id END AS content_id, CASE WHEN doc_id % 101 = 0 THEN 'unknown' WHEN doc_id % 103 = 0 THEN 'digest' WHEN doc_id % 107 = 0 AND strlen(text) <> 1 THEN 'length'
  WHEN doc_id % 109 = 0 THEN 'media_type' END AS fault FROM documents WHERE text IS NOT NULL)
SELECT content_id, batch, fault, bool_and(fault IS NULL) OVER (PARTITION BY batch) AS accepted FROM c"""


def content_route(spark, d):
    pages = table(spark, d, "pages").filter("html is not null").select((-F.col("page_id") - 1).alias("content_id"), F.encode(F.repeat("html", F.lit(20)), "UTF-8").alias("data"), F.lit("text/html").alias("media_type"))
    return ct.route(_bodies(spark, d).unionByName(pages))


ROUTE_SQL = """WITH b AS (SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT -page_id - 1, repeat(html, 20) FROM pages WHERE html IS NOT NULL)
SELECT sha256(t) AS digest, strlen(t) AS n_bytes, count(*) AS n_bodies, min(id) AS first_id, CASE WHEN strlen(t) <= 65536 THEN 'inline' ELSE 'object' END AS storage,
  CASE WHEN strlen(t) > 65536 THEN 'sha256/' || sha256(t)[1:2] || '/' || sha256(t)[3:4] || '/' || sha256(t) || '.zst' END AS object_key FROM b GROUP BY t"""


def content_attach(spark, d):
    """Contents that are new against those of even documents, and those whose stored length is another."""
    own = _bodies(spark, d).select(F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("n_bytes"), "content_id")
    stored = own.filter("content_id % 2 = 0").groupBy("digest").agg(F.min(F.when(F.col("content_id") % 26 == 0, F.col("n_bytes") + 1).otherwise(F.col("n_bytes"))).alias("n_bytes"))
    fresh, clash = ct.attach(own, stored)
    return fresh.select("digest", "n_bytes", F.lit("new").alias("outcome")).unionByName(clash.select("digest", "n_bytes", F.lit("clash").alias("outcome")).distinct())


ATTACH_SQL = """WITH o AS (SELECT sha256(text) AS digest, strlen(text) AS n_bytes, doc_id FROM documents WHERE text IS NOT NULL), s AS (SELECT digest, min(CASE WHEN doc_id % 26 = 0 THEN n_bytes + 1 ELSE n_bytes END) AS n FROM o WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT DISTINCT digest, n_bytes, 'new' AS outcome FROM o WHERE digest NOT IN (SELECT digest FROM s) UNION ALL SELECT DISTINCT digest, n_bytes, 'clash' FROM o JOIN s USING (digest) WHERE n_bytes <> n"""


def content_read(spark, d):
    """Reads of every text from a store that lost, cut or changed some."""
    b = _bodies(spark, d).withColumn("digest", F.sha2("data", 256))
    hurt = F.when(F.substring("digest", 2, 1) == "0", F.substring(F.col("data"), 1, 1)).when(F.substring("digest", 2, 1) == "1", F.encode(F.repeat(F.lit("?"), F.octet_length("data")), "UTF-8")).otherwise(F.col("data"))
    stored = b.dropDuplicates(["digest"]).filter(F.substring("digest", 1, 1) != "0").select("digest", hurt.alias("data"))
    return ct.read(b.select("content_id", "digest", F.octet_length("data").alias("n_bytes")), stored).select("content_id", "state", F.octet_length("data").cast("long").alias("got"))


READ_SQL = """WITH o AS (SELECT doc_id AS content_id, sha256(text) AS g, strlen(text) AS n, text FROM documents WHERE text IS NOT NULL), s AS (SELECT content_id, n, CASE WHEN g[1:1] = '0' THEN 'missing' WHEN g[2:2] = '0' AND n > 1 THEN 'length'
  WHEN g[2:2] = '1' AND text <> repeat('?', n) THEN 'digest' ELSE 'ok' END AS state FROM o) SELECT content_id, state, CASE WHEN state = 'ok' THEN n END AS got FROM s"""


def content_sweep(spark, d):
    """Objects of pages, as old as their number, that no page of an even id names."""
    p = table(spark, d, "pages").filter("html is not null").select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))
    now = F.lit(NOW).cast("timestamp_ntz")
    objects = p.groupBy("digest", "n_bytes").agg(F.min("page_id").alias("first")).withColumn("modified_at", now - F.make_dt_interval(hours=(F.col("first") % 60).cast("int")))
    return ct.orphans(objects, p.filter("page_id % 2 = 0"), now, 12).select("digest", "n_bytes", "modified_at")


SWEEP_SQL = f"""WITH p AS (SELECT page_id, sha256(html) AS digest, strlen(html) AS n_bytes FROM pages WHERE html IS NOT NULL), o AS (SELECT digest, n_bytes, TIMESTAMP '{NOW}' - to_hours(min(page_id) % 60) AS modified_at FROM p GROUP BY ALL)
SELECT * FROM o WHERE modified_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND digest NOT IN (SELECT digest FROM p WHERE page_id % 2 = 0)"""


def text_extraction(spark, d):
    """Conversations as JSON documents, as broken JSON and as plain text; at most 2,000 characters."""
    c = table(spark, d, "conversations")
    doc = F.to_json(F.struct("role", F.col("turn").alias("n"), F.struct(F.array("text", F.lit("end")).alias("parts")).alias("body")))
    kind = F.col("turn") % 3
    body = F.when(kind == 0, doc).when(kind == 1, F.concat(F.lit("{"), "text")).otherwise(F.replace("text", F.lit(" "), F.lit("\0")))
    media = F.when(kind == 2, "text/plain").otherwise("Application/JSON; v=1")
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), media.alias("media"), body.alias("body_text"))
    return ct.extract_text(rows, "id", "media", "body_text", 2000).select("id", F.md5("body").alias("body_md5"), F.char_length("body").cast("long").alias("n"))


EXTRACTION_SQL = """WITH b AS (SELECT conv_id || '-' || turn AS id, left(CASE turn % 3 WHEN 0 THEN role || chr(10) || text || chr(10) || 'end' WHEN 1 THEN '{' || text ELSE text END, 2000) AS body FROM conversations) SELECT id, md5(body) AS body_md5, length(body) AS n FROM b"""


def _search_claims(spark, d):
    t = table(spark, d, "documents")
    i = F.col("doc_id")
    return t.select(
        i.alias("event_id"), F.floor(i / 4).alias("content_id"), F.coalesce("lang", F.lit("-")).alias("scope"), F.sha2(F.lit("one"), 256).alias("digest"), F.array(*[F.lit(m) for m in MEDIA])[(i % 4).cast("int")].alias("media_type"),
        F.when(i % 11 == 0, "withheld").otherwise("sanitized").alias("disposition"), (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(mins=(i % 7).cast("int"))).alias("occurred_at"),
    )


def _documents(spark, d):
    c = _search_claims(spark, d)
    return ct.search_documents(c, c.filter("event_id % 53 = 0"))


def search_document_index(spark, d):
    return _documents(spark, d)[0].select("content_id", "event_id", "scope", "occurred_at", "refused")


def search_document_sources(spark, d):
    """The earliest delivered source of each content and the number of them, up to an outbox row."""
    _, provenance = _documents(spark, d)
    top = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    return ct.delivered_sources(provenance, _search_claims(spark, d), outbox(spark, d), F.lit(top // 2))[0]


CLAIMS = f"""cl AS (SELECT doc_id AS event_id, doc_id // 4 AS content_id, coalesce(lang, '-') AS scope, TIMESTAMP '{NOW}' - to_minutes(doc_id % 7) AS occurred_at FROM documents),
lv AS (SELECT * FROM cl WHERE event_id % 4 <> 3 AND event_id % 11 <> 0 AND content_id NOT IN (SELECT content_id FROM cl WHERE event_id % 53 = 0))"""
INDEX_SQL = f"""WITH {CLAIMS} SELECT content_id, arg_min(event_id, (occurred_at, event_id)) AS event_id, arg_min(scope, (occurred_at, event_id)) AS scope, min(occurred_at) AS occurred_at, min(scope) <> max(scope) AS refused FROM lv GROUP BY content_id"""
SOURCES_SQL = f"""WITH {BOX}, {CLAIMS} SELECT content_id, arg_min(lv.event_id, (lv.occurred_at, lv.event_id)) AS first_source, count(*) AS n_sources FROM lv JOIN box ON box.event_id = lv.event_id AND box.status = 'delivered'
  AND box.outbox_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY content_id"""


def embedding_upsert(spark, d):
    """Vectors of even ids stored before, all sent again later, some under another scope."""
    e = table(spark, d, "embeddings")
    old = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("content_id"), F.lit("s").alias("scope"), F.lit("g").alias("digest"), F.lit("m1").alias("model"), F.lit(1).alias("at"), F.col("embedding").alias("vector"))
    new = e.select(F.col("vec_id").alias("content_id"), F.when(F.col("vec_id") % 6 == 0, "t").otherwise("s").alias("scope"), F.lit("g").alias("digest"), F.lit("m2").alias("model"), (F.col("vec_id") % 5).cast("int").alias("at"), F.reverse("embedding").alias("vector"))
    kept, refused = ct.upsert_embeddings(old, new)
    return kept.select("content_id", "scope", "model", "at", F.lit("kept").alias("outcome")).unionByName(refused.select("content_id", "scope", "model", "at", F.lit("refused").alias("outcome")))


EMBEDDING_SQL = """SELECT vec_id AS content_id, CASE WHEN vec_id % 6 = 0 THEN 's' WHEN vec_id % 2 = 0 THEN 's' ELSE 's' END AS scope, CASE WHEN vec_id % 2 = 0 AND (vec_id % 6 = 0 OR vec_id % 5 < 1) THEN 'm1' ELSE 'm2' END AS model,
  CASE WHEN vec_id % 2 = 0 AND (vec_id % 6 = 0 OR vec_id % 5 < 1) THEN 1 ELSE vec_id % 5 END::INT AS "at", 'kept' AS outcome FROM embeddings
UNION ALL SELECT vec_id, 't', 'm2', (vec_id % 5)::INT, 'refused' FROM embeddings WHERE vec_id % 6 = 0"""


def _events(spark, d):
    """Events with scopes: projects by user, repositories by event; every error names a run, purchases are of quality and name a snapshot."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "knowledge.failure.observed").when(F.col("event_type") == "purchase", "quality.ci_run.completed").otherwise("agent.turn.started")
    return e.select(
        i, kind.alias("event_type"), F.when(F.col("user_id") % 9 != 0, F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string"))).alias("project_id"), F.concat(F.lit("r"), (i % 3).cast("string")).alias("repository_id"), F.col("ts").alias("occurred_at"),
        (F.col("ts") + F.make_dt_interval(hours=(i % 5).cast("int"))).alias("observed_at"), F.when((F.col("event_type") == "purchase") & (i % 2 == 0), i % 8).alias("snapshot_id"), F.when(F.col("event_type") == "error", i % 20).alias("run_id"), (i + 1).alias("outbox_id"),
    )


def _scope(spark, d):
    top = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    at = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return evidence.Scope(project="p1", before=at, recorded_before=at, revision=True, snapshot=4, most_outbox=int(top) * 9 // 10)


def evidence_admission(spark, d):
    return evidence.admitted(_events(spark, d), _scope(spark, d), spark.range(10).select(F.col("id").alias("run_id"))).select("event_id", "event_type")


ADMIT = """ae AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'knowledge.failure.observed' WHEN 'purchase' THEN 'quality.ci_run.completed' ELSE 'agent.turn.started' END AS event_type, ts AS occurred_at FROM events
  WHERE user_id % 9 <> 0 AND user_id % 2 = 1 AND ts < TIMESTAMP '2024-01-25' AND ts + to_hours(event_id % 5) < TIMESTAMP '2024-01-25' AND event_id + 1 <= (SELECT max(event_id) * 9 // 10 FROM events)
  AND NOT (event_type = 'purchase' AND event_id % 2 = 0 AND event_id % 8 <> 4) AND NOT (event_type = 'error' AND event_id % 20 >= 10))"""
ADMISSION_SQL = f"WITH {ADMIT} SELECT event_id, event_type FROM ae"


def evidence_newest(spark, d):
    out, cut = evidence.newest_events(_events(spark, d).filter("repository_id = 'r1'"), 100)
    return out.crossJoin(F.broadcast(cut)).select("event_id", "capped")  # one row


NEWEST_SQL = "SELECT event_id, (SELECT count(*) FROM events WHERE event_id % 3 = 1) > 100 AS capped FROM events WHERE event_id % 3 = 1 ORDER BY event_id DESC LIMIT 100"


def hit_attribution(spark, d):
    """Contents are groups of three events; each is hit by its first event, which may not be admitted."""
    events = evidence.admitted(_events(spark, d), _scope(spark, d), spark.range(10).select(F.col("id").alias("run_id")))
    provenance = _events(spark, d).select(F.floor(F.col("event_id") / 3).alias("content_id"), F.col("event_id").alias("source_id"))
    hits = provenance.groupBy("content_id").agg(F.min("source_id").alias("event_id")).withColumn("score", (F.col("content_id") % 100).cast("double"))
    cited = evidence.reattributed(hits, provenance, events)
    best = evidence.rank_by_event(cited.select("content_id", "score"), provenance, events.filter("event_type like 'quality%'"))
    return cited.select("content_id", "cited", "score").join(best.select(F.col("event_id").alias("cited"), F.col("score").alias("event_score")), "cited", "left")


ATTRIBUTION_SQL = f"""WITH {ADMIT}, h AS (SELECT event_id // 3 AS content_id, min(event_id) AS own, (event_id // 3 % 100)::DOUBLE AS score FROM events GROUP BY event_id // 3),
f AS (SELECT event_id // 3 AS content_id, arg_min(event_id, (occurred_at, event_id)) AS first FROM ae GROUP BY 1)
SELECT content_id, CASE WHEN own IN (SELECT event_id FROM ae) THEN own ELSE first END AS cited, score, CASE WHEN (CASE WHEN own IN (SELECT event_id FROM ae) THEN own ELSE first END) IN (SELECT event_id FROM ae WHERE event_type LIKE 'quality%') THEN score END AS event_score FROM h JOIN f USING (content_id)"""


def vector_topk_overfetch(spark, d):
    """The 20 nearest of one label among the nearest of all, hits of odd ids having lost their document."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 7").first()["embedding"]
    return evidence.vector_topk_overfetch(e, q, F.col("label") == 3, "vec_id", "embedding", 20, e.filter("vec_id % 2 = 0 or vec_id % 3 = 0"))


OVERFETCH_SQL = """WITH s AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rn FROM s), k AS (SELECT * FROM r WHERE label = 3 AND (vec_id % 2 = 0 OR vec_id % 3 = 0)), w(n) AS (VALUES (80), (320), (1000)),
n AS (SELECT coalesce(min(n) FILTER ((SELECT count(*) FROM k WHERE rn <= n) >= 20), 1000) AS n FROM w) SELECT vec_id, score FROM k WHERE rn <= (SELECT n FROM n) ORDER BY score DESC, vec_id LIMIT 20"""

QUERIES = {f.__name__: f for f in (content_prepare, content_route, content_attach, content_read, content_sweep, text_extraction, search_document_index, search_document_sources, embedding_upsert, evidence_admission, evidence_newest, hit_attribution, vector_topk_overfetch)}
ORACLE_SQL = {
    "content_prepare": PREPARE_SQL, "content_route": ROUTE_SQL, "content_attach": ATTACH_SQL, "content_read": READ_SQL, "content_sweep": SWEEP_SQL, "text_extraction": EXTRACTION_SQL, "search_document_index": INDEX_SQL, "search_document_sources": SOURCES_SQL,
    "embedding_upsert": EMBEDDING_SQL, "evidence_admission": ADMISSION_SQL, "evidence_newest": NEWEST_SQL, "hit_attribution": ATTRIBUTION_SQL, "vector_topk_overfetch": OVERFETCH_SQL,
}
