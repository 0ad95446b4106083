"""Packages, cursors, cover ranking, binding, binary sources, listings and rebuilds, against small examples and brute force."""

import gzip
import itertools
import random
from datetime import UTC, datetime

import pytest

from chronofold.functions import web_query
from chronofold.operators import answers, binding, rebuild
from chronofold.sources import checkout, protowire, symbol_index, telemetry

CANDIDATE = "item_id string, kind string, priority int, tier int, exact_scope boolean, distance int, match double, recency int, body string, citations array<string>"


def brute_cover(words, conjunctions):
    """Covers by trying every stretch: shortest ones that satisfy, left to right, each starting after the last one's first word."""
    live = [c for c in conjunctions if all(any(words[i] == w for i in range(len(words))) for w in c)]
    if not live:
        return 0.0
    terms = {w for c in live for w in c}
    ok = lambda i, j: any(set(c) <= set(words[i : j + 1]) for c in live)
    score, floor = 0.0, 0
    while True:
        end = next((j for j in range(floor, len(words)) if ok(floor, j)), None)
        if end is None:
            return score
        start = max(i for i in range(floor, end + 1) if ok(i, end))
        score += 0.1 / (1 + sum(w not in terms for w in words[start : end + 1]))
        floor = start + 1


def test_web_query_parse():
    assert web_query.parse('a "b c" -d or e') == [[(False, ("a",)), (False, ("b", "c")), (True, ("d",))], [(False, ("e",))]]
    assert web_query.parse("or x or") == [[(False, ("or",)), (False, ("x",)), (False, ("or",))]]
    assert web_query.parse(' "" - ! ') == []


def test_cover_density_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        words = [rng.choice("abcde") for _ in range(rng.randint(0, 14))]
        conjunctions = [rng.sample("abcx", rng.randint(1, 3)) for _ in range(rng.randint(1, 2))]
        query = [[(False, (w,)) for w in c] for c in conjunctions]
        assert web_query.cover_density(words, query) == pytest.approx(brute_cover(words, conjunctions))
    assert web_query.cover_density("a b c a b".split(), web_query.parse('"a b"')) == pytest.approx(0.2)
    assert web_query.cover_density("a b".split(), web_query.parse("a -b")) == 0.0


def test_cover_rank_nulls_and_empty_queries(spark):
    docs = spark.createDataFrame([(1, "The cat and the dog"), (2, None), (3, ""), (4, "cat dog"), (4, "cat dog")], "id long, text string")
    assert [(r["id"], r["score"]) for r in web_query.rank(docs, "cat dog", "text", "id", 9).collect()] == [(4, 0.1), (4, 0.1), (1, 0.033333)]  # two foreign words inside
    assert web_query.rank(docs, "-cat", "text", "id", 9).count() == 0


def candidates(spark, rows):
    return spark.createDataFrame(rows, CANDIDATE)


def test_merge_rank_and_cap(spark):
    rows = [("b", "file", 0, 1, False, 2, 0.5, 7, "x", ["e2"]), ("b", "symbol", 1, 1, True, None, 0.25, None, "y", ["e1", "e2"]), ("a", "file", 0, 1, False, None, 0.0, 9, "z", []), ("c", "file", 0, 1, False, None, 0.0, 9, "z", [])]
    merged = answers.merge_candidates(candidates(spark, rows))
    b = merged.filter("item_id = 'b'").first()
    assert (b["kind"], b["priority"], b["exact_scope"], b["distance"], b["match"], b["recency"], b["citations"]) == ("symbol", 1, True, 2, 0.5, 7, ["e1", "e2"])
    ranked = [(r["item_id"], r["rank"], r["score"], r["capped"]) for r in answers.rank_candidates(merged, cap=2).orderBy("rank").collect()]
    assert ranked == [("b", 1, round((100 + 4 + 6 + 20 / 3 + 20) * 1e6), True), ("a", 2, 7_000_000, True)]
    assert answers.rank_candidates(answers.merge_candidates(candidates(spark, []))).count() == 0


def test_package_is_contiguous_and_drops_the_first_excerpt(spark):
    rows = [(f"i{n}", "file", 0, 9 - n, False, None, 0.0, None, "long " * (100 if n == 0 else 1), ["e"]) for n in range(5)]
    ranked = answers.rank_candidates(answers.merge_candidates(candidates(spark, rows)))
    first = answers.require_page(answers.package(ranked, 0, 2, 200, 1000), 0)
    assert (first["position"], first["truncated"], "long long" in first["items"]) == (2, True, False)
    assert len(first["items"].encode()) <= 200
    rest = answers.package(ranked, first["position"], 10, 10_000, 10_000).first()
    assert (rest["position"], rest["truncated"], rest["items"].count("item_id")) == (5, False, 3)
    with pytest.raises(answers.BudgetTooSmall):
        answers.require_page(answers.package(ranked, 0, 2, 20, 1000), 0)
    assert answers.package(ranked, 5, 10, 1000, 1000).first()["items"] == "[]"


def test_cursors():
    c = answers.Cursors(b"k" * 32)
    digest = answers.query_digest("find", "me", {"q": "x", "cursor": "old"})
    assert digest == answers.query_digest("find", "me", {"q": "x"})
    token = c.issue(digest, 7, "snap", now=100)
    assert c.read(token, digest, "snap", now=999) == 7
    for args, reason in [((token, "0" * 64, "snap", 200), "mismatch"), ((token, digest, "snap", 1000), "expired"), ((token, digest, "new", 200), "stale"), (("A" + token[1:], digest, "snap", 200), "invalid"), (("é", digest, "snap", 200), "invalid"), (("", digest, "snap", 200), "invalid")]:
        with pytest.raises(answers.CursorError) as error:
            c.read(*args)
        assert error.value.reason == reason
    with pytest.raises(ValueError):
        answers.Cursors(b"short")


def test_import_resolution(spark):
    refs = spark.createDataFrame([("a.b.c", False, 1, "d.x"), ("a.b", True, 1, "c"), ("a.b.c", False, 2, "b"), ("a.b.c", False, 4, "q"), ("a.b.c", False, 3, "a.b"), ("z", False, 0, "a.b.c.f.g"), ("z", False, 0, "os.path"), ("a.b.c", False, 1, "e.f.g")], "importer string, is_package boolean, level int, target string")
    modules = spark.createDataFrame([("a.b",), ("a.b.c",), ("a.b.d",), ("a.b",)], "module string")
    got = {(r["level"], r["target"]): (r["outcome"], r["module"], r["rest"], r["external"]) for r in binding.resolve_imports(refs, modules).collect()}
    assert got == {
        (1, "d.x"): ("bound", "a.b.d", "x", None), (1, "c"): ("bound", "a.b.c", "", None), (2, "b"): ("bound", "a.b", "", None), (4, "q"): ("unresolved", None, None, None),
        (3, "a.b"): ("bound", "a.b", "", None), (0, "a.b.c.f.g"): ("bound", "a.b.c", "f.g", None), (0, "os.path"): ("external", None, None, "os"), (1, "e.f.g"): ("unresolved", None, None, None),
    }


def test_specifiers(spark):
    files = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/a.js", "src/b/index.ts", "index.js"]], "path string")
    refs = [("src/x.ts", "./a"), ("src/x.ts", "./b"), ("src/b/y.ts", "../a.js"), ("x.ts", "./"), ("x.ts", "../a"), ("x.ts", "react"), ("src/x.ts", "./gone")]
    got = {(r["importer"], r["specifier"]): (r["path"], r["outcome"]) for r in binding.resolve_specifiers(spark.createDataFrame(refs, "importer string, specifier string"), files).collect()}
    assert got == dict(zip(refs, [("src/a.ts", "bound"), ("src/b/index.ts", "bound"), ("src/a.js", "bound"), ("index.js", "bound"), (None, "unresolved"), (None, "external"), (None, "unresolved")], strict=True))


def test_wire_limits_and_errors():
    message = {1: ("n", "int", False), 2: ("s", "string", True), 3: ("f", "double", False), 4: ("r", "ints", True), 5: ("m", {1: ("n", "int", False)}, True)}
    value = {"n": -5, "s": ["", "é"], "f": 1.5, "r": [0, 300, -1], "m": [{"n": 1}, {}]}
    body = protowire.write(value, message)
    assert protowire.read(body, message) == value
    assert protowire.read(body + b"\xf8\x07\x01", message) == value  # an unknown field
    for cut in range(1, len(body)):
        try:
            protowire.read(body[:cut], message)
        except protowire.Malformed:
            pass
    for bad in (b"\x0a\x01a", b"\x00\x01", b"\x0b", b"\xff" * 11, b"\x12\x01\xff", b"\x12\x09a"):
        with pytest.raises(protowire.Malformed):
            protowire.read(bad, message)
    with pytest.raises(protowire.TooLarge):
        protowire.read(body, message, protowire.Budget(fields=4))
    with pytest.raises(protowire.TooLarge):
        protowire.read(body, message, protowire.Budget(objects=2))


def request(own, shared="cli", end=10**18, events=()):
    text = lambda d: [{"key": k, "value": v if isinstance(v, dict) else {"string": v}} for k, v in d.items()]
    one = {"trace_id": b"\1", "span_id": b"\2", "end": end, "attributes": text(own), "events": [{"time": t, "attributes": text(a)} for t, a in events]}
    return protowire.write({"resources": [{"resource": {"attributes": text({"service.name": shared})}, "scopes": [{"spans": [one]}]}]}, telemetry.REQUEST)


def test_telemetry_outcomes(spark):
    good = {"event.name": "start", "conversation.id": "c", "event.timestamp": "2001-01-01T00:00:00Z", "model": "m"}
    bodies = {
        "ok": request(good), "zip": gzip.compress(request(good)), "cut": gzip.compress(request(good))[:-9], "null": None, "junk": b"\xff\xff", "none": request({"a": "b"}),
        "marker": request({**good, "own": "x"}), "service": request(good, "other"), "late": request(good, end=9 * 10**18), "time": request(good, end=0), "gap": request({**good, "event.name": "else"}),
        "missing": request({"event.name": "start"}), "kind": request({**good, "model": {"bytes": b"x"}}), "naive": request({**good, "event.timestamp": "2001-01-01"}), "events": request({}, events=[(10**18, good), (5, {"x": "y"}), (0, good)]),
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None, 1) for k, v in bodies.items()], "path string, content binary, record int")
    rows = telemetry.drafts(df, ["cli"], "start", "own", datetime(2026, 1, 1, tzinfo=UTC)).collect()
    got = {k: [r["outcome"] for r in sorted(g, key=lambda r: r["record"])] for k, g in itertools.groupby(sorted(rows, key=lambda r: r["source"]), key=lambda r: r["source"])}
    assert got == {
        "ok": ["accepted"], "zip": ["accepted"], "cut": ["malformed"], "null": ["malformed"], "junk": ["malformed"], "marker": ["platform_origin"], "service": ["unknown_service"], "late": ["future_timestamp"],
        "time": ["missing_timestamp"], "gap": ["unmapped"], "missing": ["missing_attribute"], "kind": ["invalid_attribute"], "naive": ["invalid_attribute"], "events": ["accepted", "missing_timestamp"],
    }


def test_symbol_index(spark):
    assert symbol_index.valid_symbol("local 4") and symbol_index.valid_symbol("npm  . pkg 1.0 `a b`/C#m(+1).(p)[T]") is False
    assert symbol_index.valid_symbol("scip npm pkg 1.0 `a``b`/C#m(+1).(p)[T]") and symbol_index.valid_symbol("s . . . x.") and not symbol_index.valid_symbol("s . . . x")
    doc = {"path": "a.ts", "symbols": [{"symbol": "s . . . x.", "kind": 3, "relationships": [{"symbol": "s . . . y.", "is_reference": True}, {"symbol": "s . . . y."}]}],
           "occurrences": [{"range": [1, 2, 5], "symbol": "s . . . x.", "roles": 1, "enclosing": [0, 0, 9, 0]}, {"range": [1, 2, 5], "symbol": "s . . . x.", "enclosing": [2, 0, 9, 0]}, {"range": [1, 2], "symbol": "local 1"}, {"range": [0, 0, 1], "symbol": "bad"}, {"range": [3, 0, 4, 1], "symbol": "local 1"}]}
    good = protowire.write({"documents": [doc, {"path": "../b"}]}, symbol_index.INDEX)
    df = spark.createDataFrame([("g", bytearray(good)), ("n", None), ("e", bytearray(b"")), ("j", bytearray(b"\x12\x7f"))], "path string, content binary")
    got = sorted(((r["index"], r["record"], r["detail"] or "", r["start_line"]) for r in symbol_index.read_index(df).collect()), key=str)
    assert got == sorted([
        ("g", "symbol", "3", None), ("g", "relation", "is_reference s . . . y.", None), ("g", "diagnostic", "invalid_relation", None), ("g", "definition", "", 1), ("g", "diagnostic", "invalid_range", None),
        ("g", "diagnostic", "invalid_range", None), ("g", "diagnostic", "invalid_symbol", 0), ("g", "reference", "", 3), ("g", "diagnostic", "unsafe_path", None), ("n", "diagnostic", "malformed", None), ("j", "diagnostic", "malformed", None),
    ], key=str)
    assert len(got) == 11
    limited = symbol_index.read_index(df.filter("path = 'g'"), limits={"fields": 3, "objects": 9}).collect()
    assert [r["detail"] for r in limited] == ["too_large"]


def test_listings(spark):
    oid = "a" * 40
    text = f"100644 {oid} 0\tsrc/a b.py\x00100644 {oid} 1\tc\x00100644 {oid} 2\tc\x00100644 {oid} 0\t.git/x\x00junk\x00"
    df = spark.createDataFrame([("r", text), ("n", None), ("e", "")], "repo string, listing string")
    got = {(r["path"]): (r["state"], r["oid"]) for r in checkout.index_listing(df, "repo", "listing").collect()}
    assert got == {"src/a b.py": ("entry", oid), "c": ("conflicted", None), ".git/x": ("rejected", None), "junk": ("rejected", None)}
    z = "0" * 40
    status = f"# head\x001 .M N... 1 1 1 {z} {z} a b\x002 R. N... 1 1 1 {z} {z} R90 new\x002 old\x00u UU N... 1 1 1 1 {z} {z} {z} m\x00? dir/\x00? f\x00! ig\x00bad"
    want = [("a b", None, ".M", "changed"), ("new", "2 old", "R.", "renamed"), ("m", None, "UU", "unmerged"), ("dir/", None, None, "untracked_folder"), ("f", None, None, "untracked"), ("bad", None, None, "malformed")]
    assert checkout.parse_status(status) == want
    rows = checkout.status_listing(spark.createDataFrame([("r", status), ("n", None), ("e", "")], "repo string, s string"), "repo", "s").collect()
    assert [tuple(r)[1:] for r in rows] == want
    index = spark.createDataFrame([("r", p, "1") for p in "abcd"], "repo string, path string, oid string")
    seen = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "2")], "repo string, path string, blob string")
    dirty = checkout.dirty_entries(index, seen, spark.createDataFrame([("r", "c")], "repo string, path string"), "repo").collect()
    assert sorted((r["path"], r["reason"]) for r in dirty) == [("b", "race"), ("c", "changed"), ("d", "missing")]


def test_rebuild_swaps_only_verified_versions(spark, tmp_path):
    p = rebuild.Projection(spark, f"file://{tmp_path}/nodes")
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, v string")
    assert p.version() is None
    with pytest.raises(rebuild.Refused):
        p.read()
    want = rebuild.table_digest(rows.orderBy("v").select("v", "id"))
    first = p.stage(rows)
    assert p.publish(first, want) == want and p.read().count() == 3
    bad = p.stage(rows.limit(1))
    with pytest.raises(rebuild.Refused):
        p.publish(bad, want)
    assert p.version() == first and p.retire() == [bad]
    empty = p.stage(rows.limit(0))
    assert p.publish(empty) == (0, "") and p.read().count() == 0 and p.retire() == [first]
    assert rebuild.table_digest(rows) != rebuild.table_digest(rows.fillna("null"))
