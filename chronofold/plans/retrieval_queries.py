"""Graph, search, ranking and streaming queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import graph, search
from chronofold.plans.ledger_queries import SESSION_SQL
from chronofold.sources.scratch import shared_folder
from chronofold.sources.tables import ledger, table
from chronofold.streaming.fold import fold_stream

TERMS = ["the", "der", "que"]


def _trade_all(spark, d):
    """Directed nation edges: a supplier's nation sells to a customer's, over all order lines; loops and cycles occur."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o, c, s = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "supplier")
    return (
        line.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).distinct()
    )


def _trade(spark, d):
    """Those edges that lead to a greater key, at most six away: without cycles."""
    return _trade_all(spark, d).filter("dst > src and dst - src <= 6")


TRADE = """tr AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey > s_nationkey AND c_nationkey - s_nationkey <= 6)"""


TRADE_ALL = TRADE.replace("\n  WHERE c_nationkey > s_nationkey AND c_nationkey - s_nationkey <= 6", "")


def _anchor(spark, ident):
    return spark.createDataFrame([(ident,)], "id long")


def graph_neighborhood(spark, d, trade=_trade):
    return graph.neighbourhood(trade(spark, d), _anchor(spark, 3), 4)


def graph_callees(spark, d, trade=_trade):
    return graph.neighbourhood(trade(spark, d), _anchor(spark, 3), 3, directed=True)


def graph_callers(spark, d, trade=_trade):
    edges = trade(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.neighbourhood(edges, _anchor(spark, 20), 3, directed=True)


def _walk_sql(links, start, depth):
    return f"""WITH RECURSIVE {TRADE}, ln AS ({links}), w AS (SELECT CAST({start} AS BIGINT) AS id, CAST(0 AS BIGINT) AS distance UNION SELECT ln.dst, w.distance + 1 FROM w JOIN ln ON ln.src = w.id WHERE w.distance < {depth})
SELECT id, min(distance) AS distance FROM w GROUP BY id"""


def graph_paths(spark, d, trade=_trade):
    return graph.simple_paths(trade(spark, d), 3, 20, 4)


def graph_neighborhood_all(spark, d):
    return graph_neighborhood(spark, d, _trade_all)


def graph_callees_all(spark, d):
    return graph_callees(spark, d, _trade_all)


def graph_callers_all(spark, d):
    return graph_callers(spark, d, _trade_all)


def graph_paths_all(spark, d):
    return graph_paths(spark, d, _trade_all)


PATHS_SQL = f"""WITH RECURSIVE {TRADE}, w AS (SELECT [src, dst] AS nodes, dst AS tail FROM tr WHERE src = 3 UNION ALL SELECT list_append(nodes, tr.dst), tr.dst FROM w JOIN tr ON tr.src = w.tail WHERE w.tail <> 20 AND len(nodes) <= 4 AND NOT list_contains(nodes, tr.dst))
SELECT array_to_string(nodes, '>') AS path, len(nodes) - 1 AS hops FROM w WHERE tail = 20"""


def graph_dependencies(spark, d):
    """External dependencies of the suppliers of a nation: parts, with the number of lines that name them."""
    s = table(spark, d, "supplier").filter("s_nationkey = 3").select("s_suppkey")
    line = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return line.join(s, line.l_suppkey == s.s_suppkey).groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))


DEPENDENCIES_SQL = "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 3 GROUP BY ALL"


def _english(spark, d):
    return table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "text")


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _whole(sql):
    """The SQL over the documents of every language, and of none."""
    return sql.replace("FROM documents WHERE lang = 'en'", "FROM documents")


def lexical_or_topk(spark, d, docs=_english):
    return search.lexical_or(docs(spark, d), ["tion", "there", "house"] + TERMS, "text", "doc_id", 100)


WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
LEXICAL_SQL = f"""SELECT doc_id, score FROM (SELECT doc_id, len(list_filter({WORDS}, lambda x: x IN ('tion', 'there', 'house', 'the', 'der', 'que'))) AS score FROM documents WHERE lang = 'en') WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100"""


def lexical_or_topk_all(spark, d):
    return lexical_or_topk(spark, d, _documents)


def lexical_and_phrase(spark, d, docs=_english):
    return search.lexical_phrase(docs(spark, d), ["the", "and"], ["of", "the"], "text", "doc_id", 100)


PHRASE_SQL = f"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE lang = 'en'), n AS (SELECT doc_id, w, (SELECT count(*) FROM range(1, len(w)) r(i) WHERE w[i] = 'of' AND w[i + 1] = 'the') AS score FROM t)
SELECT doc_id, score FROM n WHERE score > 0 AND list_contains(w, 'the') AND list_contains(w, 'and') ORDER BY score DESC, doc_id LIMIT 100"""


def lexical_and_phrase_all(spark, d):
    return lexical_and_phrase(spark, d, _documents)


def _query_vector(spark, d):
    return table(spark, d, "embeddings").filter("vec_id = 7").select(F.col("embedding").alias("q"))


def vector_topk(spark, d):
    return search.cosine_topk(table(spark, d, "embeddings"), _query_vector(spark, d), "embedding", "vec_id", 50)


def vector_topk_scoped(spark, d):
    return search.cosine_topk(table(spark, d, "embeddings").filter("label = 3"), _query_vector(spark, d), "embedding", "vec_id", 20)


def _vector_sql(where, k):
    return f"""SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings {where} ORDER BY score DESC, vec_id LIMIT {k}"""


def token_overlap(spark, d):
    words = search.tokens(F.col("text"))
    out = table(spark, d, "documents").select("doc_id", words.alias("w"))
    return out.select("doc_id", search.token_overlap(out, "w", TERMS).alias("overlap")).filter("overlap > 0")


OVERLAP_SQL = f"""SELECT doc_id, overlap FROM (SELECT doc_id, round(len(list_filter(['the', 'der', 'que'], lambda x: list_contains({WORDS}, x))) / 3.0, 6) AS overlap FROM documents) WHERE overlap > 0"""


def rank_fusion(spark, d, docs=_english):
    """Candidates of two retrievers merged by id, scored in integer micro-units: retriever priority, length tier, match and recency."""
    lex = lexical_or_topk(spark, d, docs).select(F.col("doc_id").alias("id"), F.col("score").cast("double").alias("m"), F.lit(1).alias("priority"))
    lex = lex.withColumn("m", F.col("m") / F.max("m").over(Window.partitionBy(F.lit(1))))  # at most 100 rows
    vec = vector_topk(spark, d).select(F.col("vec_id").alias("id"), (F.col("score") * 0.8).alias("m"), F.lit(2).alias("priority")).filter("m >= 0.24")
    merged = lex.unionByName(vec).groupBy("id").agg(F.max("m").alias("m"), F.max("priority").alias("priority"), F.count("*").alias("n"))
    dense = F.dense_rank().over(Window.orderBy("id"))
    top = merged.withColumn("r", dense)
    top = top.withColumn("top", F.max("r").over(Window.partitionBy(F.lit(1))))  # at most 150 rows
    recency = F.when(F.col("top") == 1, 1.0).otherwise((F.col("r") - 1) / (F.col("top") - 1))
    score = 100 * F.col("priority") + 4 * F.col("n") + 40 * F.round("m", 6) + 3 * recency
    return top.select("id", F.bround(score * 1000, 0).cast("long").alias("score"))


FUSION_SQL = f"""WITH lex AS ({LEXICAL_SQL}), vec AS ({_vector_sql('', 50)}),
u AS (SELECT doc_id AS id, CAST(score AS DOUBLE) / max(score) OVER () AS m, 1 AS priority FROM lex UNION ALL SELECT vec_id, score * 0.8, 2 FROM vec WHERE score * 0.8 >= 0.24),
g AS (SELECT id, max(m) AS m, max(priority) AS priority, count(*) AS n, dense_rank() OVER (ORDER BY id) AS r FROM u GROUP BY id)
SELECT id, CAST(round_even((100 * priority + 4 * n + 40 * round(m, 6) + 3 * (CASE WHEN (SELECT max(r) FROM g) = 1 THEN 1.0 ELSE (r - 1) / ((SELECT max(r) FROM g) - 1) END)) * 1000, 0) AS BIGINT) AS score FROM g"""


def rank_fusion_all(spark, d):
    return rank_fusion(spark, d, _documents)


def budget_page(spark, d, docs=_english):
    ranked = docs(spark, d).orderBy(F.octet_length("text"), "doc_id").limit(500)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.octet_length("text"), "doc_id")).cast("long"))
    return search.budget_page(ranked, "rank", "text", 20_000, 200).select("doc_id", "rank", "bytes", "total")


PAGE_SQL = """WITH r AS (SELECT doc_id, strlen(text) AS bytes, row_number() OVER (ORDER BY strlen(text), doc_id) AS rank FROM documents WHERE lang = 'en' ORDER BY rank LIMIT 500)
SELECT * FROM (SELECT doc_id, rank, bytes, CAST(sum(bytes) OVER (ORDER BY rank) + rank - 1 + 2 AS BIGINT) AS total FROM r) WHERE total <= 20000 AND rank <= 200"""


def budget_page_all(spark, d):
    return budget_page(spark, d, _documents)


def page_structure(spark, d):
    """Links and headings of every page, as a table function made of built-in functions."""
    p = table(spark, d, "pages").filter("html is not null").select("page_id", "html")
    links = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "value")).withColumn("kind", F.lit("link"))
    heads = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), F.lit(1))).alias("pos", "value")).withColumn("kind", F.lit("heading"))
    return links.unionByName(heads).select("page_id", "kind", F.col("pos").cast("long").alias("pos"), "value")


STRUCTURE_SQL = """SELECT page_id, 'link' AS kind, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS pos, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS value FROM pages
UNION ALL SELECT page_id, 'heading', unnest(range(len(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)))), unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) FROM pages"""


def stream_fold_equivalence(spark, d):
    """The session fold through Structured Streaming in several micro-batches gives the batch fold's table."""
    return fold_stream(ledger(spark, d), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


QUERIES = {f.__name__: f for f in (graph_neighborhood, graph_callers, graph_callees, graph_paths, graph_dependencies, lexical_or_topk, lexical_and_phrase, vector_topk, vector_topk_scoped, token_overlap, rank_fusion, budget_page, page_structure, stream_fold_equivalence, lexical_or_topk_all, lexical_and_phrase_all, rank_fusion_all, budget_page_all, graph_neighborhood_all, graph_callers_all, graph_callees_all, graph_paths_all)}
ORACLE_SQL = {
    "graph_neighborhood": _walk_sql("SELECT src, dst FROM tr UNION SELECT dst, src FROM tr", 3, 4), "graph_callees": _walk_sql("SELECT src, dst FROM tr", 3, 3), "graph_callers": _walk_sql("SELECT dst AS src, src AS dst FROM tr", 20, 3),
    "graph_paths": PATHS_SQL, "graph_dependencies": DEPENDENCIES_SQL, "lexical_or_topk": LEXICAL_SQL, "lexical_and_phrase": PHRASE_SQL, "vector_topk": _vector_sql("", 50), "vector_topk_scoped": _vector_sql("WHERE label = 3", 20),
    "token_overlap": OVERLAP_SQL, "rank_fusion": FUSION_SQL, "budget_page": PAGE_SQL, "page_structure": STRUCTURE_SQL, "stream_fold_equivalence": SESSION_SQL,
    "lexical_or_topk_all": _whole(LEXICAL_SQL), "lexical_and_phrase_all": _whole(PHRASE_SQL), "rank_fusion_all": _whole(FUSION_SQL), "budget_page_all": _whole(PAGE_SQL),
    "graph_paths_all": PATHS_SQL.replace(TRADE, TRADE_ALL).replace("WHERE src = 3 UNION", "WHERE src = 3 AND dst <> 3 UNION"),
}
ORACLE_SQL |= {f"{n}_all": ORACLE_SQL[n].replace(TRADE, TRADE_ALL) for n in ("graph_neighborhood", "graph_callers", "graph_callees")}
