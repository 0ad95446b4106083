"""The lineage walk against a plain replay of the same rules, and its cases one by one."""

from chronofold.operators import lineage
from chronofold.plans import emission_queries

DATA = "/root/testdata/sf0.001"


def test_cases():
    state = lineage.Lineage("r")
    run = lambda commit, *changes: {row[0]: row[1:] for row in state.commit(commit, list(changes))}
    first = run("c1", ("A", "a", "1"), ("A", "b", "2"), ("A", "c", "2"))
    assert {v[1] for v in first.values()} == {"introduced"} and len({v[0] for v in first.values()}) == 3
    moved = run("c2", ("D", "a", None), ("A", "x", "1"))
    assert moved["x"] == (first["a"][0], "moved", first["a"][0], 1.0) and moved["a"][1] == "deleted"
    split = run("c3", ("D", "b", None), ("D", "c", None), ("A", "y", "2"))
    assert split["y"][1:] == ("ambiguous", first["b"][0], 0.5) and split["y"][0] not in {v[0] for v in first.values()}
    again = run("c4", ("A", "b", "9"), ("M", "x", "3"), ("D", "nothing", None))
    assert again["b"][1:] == ("path_reused", first["b"][0], 0.25) and again["x"] == (first["a"][0], "modified", None, None) and "nothing" not in again


def test_walk_keeps_repositories_apart(spark):
    rows = [(f"r{k % 7}", k // 7, f"c{k // 7}", "AMD"[(k // 7 + j) % 3], f"p{j % 4}", str((k + j) % 3)) for k in range(140) for j in range(5) if j != k % 5]
    rows = list({r[:3] + (r[4],): r for r in rows}.values())
    got = {(r["repository"], r["seq"], r["path"]): (r["file_id"], r["basis"], r["old_id"], r["confidence"]) for r in lineage.walk(spark.createDataFrame(rows, "repository string, seq long, commit string, status string, path string, blob string").repartition(5)).collect()}
    want = {}
    for repository in sorted({r[0] for r in rows}):
        state = lineage.Lineage(repository)
        for seq in sorted({r[1] for r in rows if r[0] == repository}):
            changes = [r[3:] for r in rows if r[:2] == (repository, seq)]
            want |= {(repository, seq, row[0]): tuple(row[1:]) for row in state.commit(f"c{seq}", changes)}
    assert got == want and {v[1] for v in want.values()} >= {"introduced", "modified", "deleted", "moved"}


def test_query(spark):
    assert emission_queries.file_lineage(spark, DATA).filter("file_id is null").count() == 0
