"""The registered queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.plans import answer_queries, content_queries, delivery_queries, detail_queries, emission_queries, fold_queries, graph_read_queries, history_queries, identity_queries, ledger_queries, question_queries, retrieval_queries, secondary_queries, timeline_queries, verify_queries

FLAGSHIP = "session_fold"
_PARTS = (ledger_queries, history_queries, retrieval_queries, secondary_queries, answer_queries, verify_queries, fold_queries, graph_read_queries, delivery_queries, timeline_queries, identity_queries, content_queries, emission_queries, question_queries, detail_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for p in _PARTS for k, q in p.ORACLE_SQL.items()}
