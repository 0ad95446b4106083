"""Answer packages, dense-cover ranking, import binding and the binary sources, over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import functions as F

from chronofold.functions import web_query
from chronofold.operators import answers, binding
from chronofold.plans.retrieval_queries import LEXICAL_SQL, PHRASE_SQL, WORDS, _documents, _english, _whole, lexical_and_phrase, lexical_or_topk
from chronofold.sources import checkout, protowire, symbol_index, telemetry
from chronofold.sources.tables import table


def cover_density(spark, d):
    return web_query.rank(table(spark, d, "documents"), "the and", "text", "doc_id", 100)


COVER_SQL = f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS pos FROM documents),
p AS (SELECT doc_id, w, pos, lag(w) OVER o AS before, lag(pos) OVER o AS prev FROM w WHERE w IN ('the', 'and') WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, round(sum(0.1 / CAST(pos - prev AS DOUBLE)), 6) AS score FROM p WHERE before <> w GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 100"""


def _candidates(spark, d, of=_english):
    """Two capped reads as candidates of one answer: words in any order, and a phrase, which counts as the exact scope."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    reads = [
        (lexical_or_topk(spark, d, of), "content", 0, 1, False, None, F.round(F.col("score") / (F.col("score") + 50), 6)),
        (lexical_and_phrase(spark, d, of), "phrase", 1, 2, True, 1, F.round(F.col("score") / (F.col("score") + 10), 6)),
    ]
    out = None
    for hits, kind, priority, tier, exact, distance, match in reads:
        one = hits.join(docs, "doc_id").select(
            F.format_string("d%010d", "doc_id").alias("item_id"), F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), F.lit(tier).alias("tier"), F.lit(exact).alias("exact_scope"),
            F.lit(distance).cast("int").alias("distance"), match.alias("match"), F.col("doc_id").alias("recency"), F.col("source").alias("body"), F.array(F.concat(F.lit(kind), F.lit(":"), "source")).alias("citations"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def candidate_rank(spark, d, of=_english):
    ranked = answers.rank_candidates(answers.merge_candidates(_candidates(spark, d, of)))
    return ranked.select("item_id", "kind", "score", "rank", F.array_join("citations", ",").alias("citations"), "capped")


def candidate_rank_all(spark, d):
    return candidate_rank(spark, d, _documents)


RANKED = f"""lex AS ({LEXICAL_SQL}), ph AS ({PHRASE_SQL}),
u AS (SELECT doc_id, 'content' AS kind, 0 AS p, 1 AS t, 0 AS e, NULL AS dist, round(score / (score + 50), 6) AS m FROM lex UNION ALL SELECT doc_id, 'phrase', 1, 2, 1, 1, round(score / (score + 10), 6) FROM ph),
g AS (SELECT doc_id, max(kind) AS kind, max(p) AS p, max(t) AS t, max(e) AS e, min(dist) AS dist, max(m) AS m, list_sort(list_distinct(list(kind || ':' || source))) AS citations, any_value(source) AS source FROM u JOIN documents USING (doc_id) GROUP BY doc_id),
q AS (SELECT *, CASE WHEN count(*) OVER () = 1 THEN 1.0::DOUBLE ELSE (row_number() OVER (ORDER BY doc_id) - 1)::DOUBLE / (count(*) OVER () - 1) END AS r FROM g),
s AS (SELECT *, 'd' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS item_id, CAST(round_even((100 * p + 4 * t + 6 * e + coalesce(20.0::DOUBLE / (1 + dist), 0.0) + 40.0::DOUBLE * m + 3.0::DOUBLE * r) * 1000000, 0) AS BIGINT) AS score FROM q),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM s)"""
RANK_SQL = f"WITH {RANKED} SELECT item_id, kind, score, rank, array_to_string(citations, ',') AS citations, false AS capped FROM ranked"


def answer_page(spark, d, of=_english):
    """The second page of an answer: ranks after the tenth within 2,000 bytes."""
    ranked = answers.rank_candidates(answers.merge_candidates(_candidates(spark, d, of)))
    return answers.page(ranked, 10, 50, 2000, 10_000).select("item_id", "rank", "bytes", "used", "quoted")


def answer_page_all(spark, d):
    return answer_page(spark, d, _documents)


ANSWER_SQL = f"""WITH {RANKED}, b AS (SELECT item_id, rank, strlen('{{"item_id":"' || item_id || '","kind":"' || kind || '","score":' || score || ',"citations":["' || array_to_string(citations, '","') || '"],"body":"' || source || '"}}') AS bytes FROM ranked WHERE rank > 10)
SELECT * FROM (SELECT item_id, rank, bytes, CAST(sum(bytes) OVER (ORDER BY rank) + row_number() OVER (ORDER BY rank) + 1 AS BIGINT) AS used, true AS quoted FROM b) WHERE used <= 2000"""


def _module(brand, kind):
    return F.concat(F.lit("shop."), F.lower(F.replace(brand, F.lit("#"), F.lit("_"))), F.lit("."), F.lower(kind))


def import_binding(spark, d):
    """Modules are the brands' part types; every part imports a name of a module by level: absolute, of its package, or above its root."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    level = F.when(F.col("p_size") <= 20, 0).when(F.col("p_size") <= 40, 1).otherwise(9)
    words = F.lower(F.col("p_type"))
    target = F.when(F.col("p_size") <= 10, F.concat(F.lit("shop.brand_7."), words, F.lit(".name"))).when(F.col("p_size") <= 20, F.concat(words, F.lit(".name"))).when(F.col("p_size") <= 30, F.concat(words, F.lit(".name"))).otherwise(F.concat(F.lit("gone."), words))
    refs = p.select(_module(F.col("p_brand"), F.col("p_type")).alias("importer"), F.lit(False).alias("is_package"), level.alias("level"), target.alias("target"))
    modules = p.select(_module(F.col("p_brand"), F.col("p_type")).alias("module"))
    return binding.resolve_imports(refs, modules).select("importer", "level", "target", "module", "rest", "external", "outcome")


BIND_SQL = """WITH p AS (SELECT 'shop.' || lower(replace(p_brand, '#', '_')) AS pkg, lower(p_type) AS w, p_size AS z FROM part), m AS (SELECT DISTINCT pkg || '.' || w AS module FROM p),
r AS (SELECT DISTINCT pkg || '.' || w AS importer, pkg, CASE WHEN z <= 20 THEN 0 WHEN z <= 40 THEN 1 ELSE 9 END AS level,
  CASE WHEN z <= 10 THEN 'shop.brand_7.' || w || '.name' WHEN z <= 30 THEN w || '.name' ELSE 'gone.' || w END AS target FROM p),
n AS (SELECT *, CASE level WHEN 0 THEN target WHEN 1 THEN pkg || '.' || target END AS name FROM r),
b AS (SELECT n.*, m.module FROM n LEFT JOIN m ON n.name = m.module || '.name')
SELECT importer, CAST(level AS INTEGER) AS level, target, module, CASE WHEN module IS NOT NULL THEN 'name' END AS rest, CASE WHEN module IS NULL AND level = 0 THEN split_part(name, '.', 1) END AS external,
  CASE WHEN module IS NOT NULL THEN 'bound' WHEN level = 0 THEN 'external' ELSE 'unresolved' END AS outcome FROM b"""


def index_listing(spark, d):
    """Parts in blocks of 1,000 ids as index listings, which are read back: sizes over 40 are in conflict, a few paths are unsafe."""
    p = table(spark, d, "part").withColumn("checkout", F.floor(F.col("p_partkey") / 1000))
    path = F.concat(F.when(F.col("p_size") == 1, "../").otherwise(""), F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string"))
    line = F.concat(F.lit("100644 "), F.sha1(F.col("p_partkey").cast("string")), F.when(F.col("p_size") > 40, " 2").otherwise(" 0"), F.lit("\t"), path)
    listings = p.groupBy("checkout").agg(F.array_join(F.collect_list(line), "\0").alias("listing"))
    return checkout.index_listing(listings, "checkout", "listing")


LISTING_SQL = """WITH p AS (SELECT p_partkey // 1000 AS checkout, (CASE WHEN p_size = 1 THEN '../' ELSE '' END) || lower(p_type) || '/' || p_partkey AS path, sha1(CAST(p_partkey AS VARCHAR)) AS oid, p_size AS z FROM part)
SELECT checkout, path, CASE WHEN z <> 1 THEN '100644' END AS mode, CASE WHEN z <> 1 AND z <= 40 THEN oid END AS oid, CASE WHEN z = 1 THEN 'rejected' WHEN z <= 40 THEN 'entry' ELSE 'conflicted' END AS state FROM p"""


def _text(key, value):
    return {"key": key, "value": {"string": value}}


def telemetry_drafts(spark, d):
    """Every event as a one-span request, which is read back: errors come from another service, purchases without time, clicks as another event."""
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), "event_type", F.col("user_id").cast("string").alias("u"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, kind, user, stamp, second in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = [_text("event.name", "other" if kind == "click" else "session.starts"), _text("conversation.id", user), _text("event.timestamp", stamp + "+00:00")]
                one = {"name": "s", "end": 0 if kind == "purchase" else (second + 60) * 1_000_000_000, "attributes": own}
                request = {"resources": [{"resource": {"attributes": [_text("service.name", "else" if kind == "error" else "cli")]}, "scopes": [{"spans": [one]}]}]}
                out.append(protowire.write(request, telemetry.REQUEST))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    bodies = rows.mapInArrow(encode, "path string, content binary")
    got = telemetry.drafts(bodies, ["cli"], "session.starts", "platform.origin", datetime(2100, 1, 1, tzinfo=UTC))
    return got.select(F.col("source").cast("long").alias("event_id"), "session_id", F.unix_seconds("occurred_at").alias("occurred_s"), F.unix_seconds("observed_at").alias("observed_s"), "outcome")


TELEMETRY_SQL = """SELECT event_id, CASE WHEN ok THEN CAST(user_id AS VARCHAR) END AS session_id, CASE WHEN ok THEN s END AS occurred_s, CASE WHEN ok THEN s + 60 END AS observed_s, outcome FROM (
  SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type IN ('signup', 'view') AS ok,
    CASE event_type WHEN 'error' THEN 'unknown_service' WHEN 'purchase' THEN 'missing_timestamp' WHEN 'click' THEN 'unmapped' ELSE 'accepted' END AS outcome FROM events)"""


def symbol_index_rows(spark, d):
    """Every part as a symbol-index file of one document, which is read back: small sizes have a reversed range, large ones an unsafe path."""
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_name", "p_size")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, name, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                symbol = f"shop npm pkg 1.0 `{name}`/p{key}#"
                at = [size, 5, 2] if size <= 5 else [size, 2, 5]
                doc = {"path": ("/" if size > 45 else "") + f"src/{key}.ts", "symbols": [{"symbol": symbol, "kind": 7}], "occurrences": [{"range": at, "symbol": symbol, "roles": 1}]}
                out.append(protowire.write({"documents": [doc]}, symbol_index.INDEX))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    got = symbol_index.read_index(rows.mapInArrow(encode, "path string, content binary"))
    return got.select(F.col("index").cast("long").alias("p_partkey"), "record", "symbol", "detail", "start_line", "end_char")


SYMBOL_SQL = """WITH p AS (SELECT p_partkey, 'shop npm pkg 1.0 `' || p_name || '`/p' || p_partkey || '#' AS symbol, p_size AS z FROM part)
SELECT p_partkey, 'symbol' AS record, symbol, '7' AS detail, NULL::BIGINT AS start_line, NULL::BIGINT AS end_char FROM p WHERE z <= 45
UNION ALL SELECT p_partkey, CASE WHEN z <= 5 THEN 'diagnostic' ELSE 'definition' END, symbol, CASE WHEN z <= 5 THEN 'invalid_range' END, CASE WHEN z > 5 THEN z END, CASE WHEN z > 5 THEN 5 END FROM p WHERE z <= 45
UNION ALL SELECT p_partkey, 'diagnostic', NULL, 'unsafe_path', NULL, NULL FROM p WHERE z > 45"""

QUERIES = {f.__name__: f for f in (cover_density, candidate_rank, answer_page, import_binding, index_listing, telemetry_drafts, symbol_index_rows, candidate_rank_all, answer_page_all)}
ORACLE_SQL = {
    "cover_density": COVER_SQL, "candidate_rank": RANK_SQL, "answer_page": ANSWER_SQL, "import_binding": BIND_SQL, "index_listing": LISTING_SQL, "telemetry_drafts": TELEMETRY_SQL, "symbol_index_rows": SYMBOL_SQL,
    "candidate_rank_all": _whole(RANK_SQL), "answer_page_all": _whole(ANSWER_SQL),
}
