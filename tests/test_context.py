"""The five questions over one small world."""

from datetime import datetime

import pytest

from chronofold.operators import answers, context

T = [datetime(2024, 1, d) for d in range(1, 10)]


@pytest.fixture(scope="module")
def world(spark):
    make = spark.createDataFrame
    nodes = make([("f1", "file", "src/orderParser.py", "src/orderParser.py", T[0], ["e1"]), ("s1", "symbol", "shop.parse_order", "src/orderParser.py", T[0], ["e2"]), ("s2", "symbol", "shop.total", "src/b.py", T[1], ["e3"]),
                  ("s3", "symbol", "far.total", "src/c.py", T[1], ["e4"]), ("m1", "module", "shop", "src", T[0], ["e5"])], "id string, kind string, name string, path string, observed timestamp, citations array<string>")
    edges = make([("r1", "s1", "s2", "CALLS", "scip", 1.0, None, T[1], ["e6"]), ("r2", "s2", "s3", "CALLS", "tree_sitter", 0.5, "accepted", T[1], ["e7"]), ("r3", "m1", "numpy", "DEPENDS_ON", "tree_sitter", 0.9, None, T[1], ["e8"])],
                 "id string, src string, dst string, type string, evidence string, confidence double, review string, observed timestamp, citations array<string>")
    decisions = make([("d1", "accepted", "active", ["shop.parse_order"], "d0", None, T[2], ["e9"]), ("d0", "superseded", "superseded", ["old"], None, "d1", T[1], ["e10"]), ("d9", "accepted", "active", ["other"], None, None, T[1], ["e11"])],
                     "id string, status string, standing string, subjects array<string>, supersedes_id string, superseded_by string, recorded_at timestamp, citations array<string>")
    failures = make([("x1", "parser", "parse", "ValueError", "fp1", T[3], [T[6]], "unresolved", ["e12"]), ("x2", "net", "get", "Timeout", "fp2", T[0], None, "resolved", ["e13"])],
                    "id string, component string, operation string, error_class string, fingerprint string, valid_from timestamp, observed_at array<timestamp>, resolution string, citations array<string>")
    hits = make([("c1", "lexical", 4.0, "about orders", T[4], ["e20"]), ("c1", "vector", 0.5, "about orders", T[4], ["e20"]), ("c2", "lexical", 1.0, "the old way", T[4], ["e10"]), ("c3", "vector", 0.2, "noise", T[4], ["e21"]), ("c4", "vector", 0.9, "timeouts", T[4], ["e13"])],
                "content_id string, source string, score double, excerpt string, observed timestamp, citations array<string>")
    return context.World(nodes, edges, decisions, failures, hits)


def items(ranked):
    return [r["item_id"] for r in ranked.orderBy("rank").collect()]


def test_query_tokens():
    assert context.query_tokens("How to fix the parseOrder of ORDER_total ção x") == ["fix", "parse", "order", "total", "ção"]
    assert context.query_tokens("") == [] and len(context.query_tokens(" ".join(f"w{i}" for i in range(40)))) == 16
    with pytest.raises(context.RequestError):
        context.query_tokens("x" * 1001)


def test_normal_hits(world):
    got = {r["content_id"]: r["match"] for r in context.normal_hits(world.hits).collect()}
    assert got == {"c1": 1.0, "c2": 0.25, "c4": 0.72}


def test_context_for_task(world):
    got = items(context.context_for_task(world, "parse an order"))
    # c2 and c4 are carried by a decision and a failure; the resolved failure stays since a hit cites it; d0 is not active
    assert set(got) == {"file:f1", "symbol:s1", "symbol:s2", "symbol:s3", "relation:r1", "relation:r2", "decision:d1", "decision:d9", "failure:x1", "failure:x2", "content:c1"}
    assert got[0] == "symbol:s1"
    row = answers.require_page(answers.package(context.context_for_task(world, "parse an order"), 0, 3, 4000, 4000), 0)
    assert (row["position"], row["truncated"]) == (3, True)


def test_overview(world, spark):
    changes = spark.createDataFrame([("f1", "modified", T[2], ["e1"])], "id string, change string, observed timestamp, citations array<string>")
    assert set(items(context.repository_overview(world, changes))) == {"module:m1", "dependency:r3", "change:f1", "decision:d1", "decision:d9", "failure:x1"}


def test_symbol_context(world):
    got = context.symbol_context(world, "parse_order")
    assert items(got)[0] == "symbol:s1" and set(items(got)) == {"symbol:s1", "relation:r1", "relation:r2", "decision:d1"}
    assert "heuristic" in got.filter("item_id = 'relation:r2'").first()["body"] and "deterministic" in got.filter("item_id = 'relation:r1'").first()["body"]
    with pytest.raises(context.RequestError, match="ambiguous"):
        context.symbol_context(world, "total")
    with pytest.raises(context.RequestError, match="unknown"):
        context.symbol_context(world, "gone")


def test_histories(world):
    assert items(context.decision_history(world, "parse")) == ["decision:d1", "decision:d0"]
    assert set(items(context.decision_history(world, "zzz"))) == {"decision:d1", "decision:d0"}  # the hit on d0's event matches
    assert items(context.failure_history(world, T[6], T[7])) == ["failure:x1"]
    assert items(context.failure_history(world, T[0], T[7], fingerprint="fp2")) == ["failure:x2"]
    assert items(context.failure_history(world, T[7], T[8], query="parser")) == []
    assert set(items(context.failure_history(world, T[0], T[7], query="parser"))) == {"failure:x1", "failure:x2"}


def test_empty_world(world):
    empty = context.World(*[getattr(world, n).limit(0) for n in ("nodes", "edges", "decisions", "failures", "hits")])
    ranked = context.context_for_task(empty, "parse")
    assert items(ranked) == [] and answers.package(ranked, 0, 5, 1000, 1000).first()["items"] == "[]"
