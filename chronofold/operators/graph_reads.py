"""Bounded reads of the code graph of one repository: walks with a node cap, edges with evidence, alternatives, paths, dependencies.

nodes       id, kind (repository, module, file, symbol), repository_id, current
edges       type, src, dst, repository_id, assertion_id, confidence, evidence, sources (array)
assertions  assertion_id, repository_id, subject, predicate, object, current, revision_id (of a file)

Only the cap of a read reaches the driver: at most ``NODES`` ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.sources.scratch import cut_lineage

# Limits of one read, the order of kinds inside a level, and the edges that a kind is left by (type, direction, kinds reached).
NODES, PATHS, EDGES, SUBJECTS = 500, 50, 2000, 500
KINDS = ["repository", "module", "file", "symbol"]
CODE = ["CALLS", "REFERENCES", "IMPORTS", "DEFINES"]
STEPS = {
    "neighborhood": {
        "repository": [(["IN_REPOSITORY"], "in", ["file", "module"])], "module": [(["IN_MODULE"], "in", ["file"])],
        "file": [(CODE, "both", ["symbol", "file"]), (["IN_MODULE"], "out", ["module"])], "symbol": [(CODE, "both", ["symbol", "file"])],
    },
    "callers": {k: [(["CALLS"], "in", ["symbol", "file"])] for k in ("file", "symbol")},
    "callees": {k: [(["CALLS"], "out", ["symbol", "file"])] for k in ("file", "symbol")},
}
EDGE_TYPES = {"neighborhood": [*CODE, "IN_MODULE", "IN_REPOSITORY"], "callers": ["CALLS"], "callees": ["CALLS"]}


class ReadError(ValueError):
    """A read that cannot be answered: an unknown anchor, a kind without that walk, a depth outside 1 to 4."""


def live_nodes(nodes: DataFrame, edges: DataFrame, repository: str) -> DataFrame:
    """The repository's nodes that hold now: current files and symbols, modules of a current file, the repository."""
    own = nodes.filter(F.col("repository_id") == repository)
    code = own.filter(F.col("kind").isin("file", "symbol") & F.col("current"))
    kept = edges.filter((F.col("type") == "IN_MODULE") & (F.col("repository_id") == repository)).join(code.filter("kind = 'file'").select(F.col("id").alias("src")), "src", "left_semi")
    modules = own.filter("kind = 'module'").join(kept.select(F.col("dst").alias("id")), "id", "left_semi")
    return reduce(DataFrame.unionByName, [x.select("id", "kind") for x in (code, modules, own.filter("kind = 'repository'"))])


def walk(nodes: DataFrame, edges: DataFrame, repository: str, anchor, depth: int, mode: str = "neighborhood", cap: int = NODES) -> tuple[DataFrame, bool]:
    """((id, kind, distance), truncated) by levels; inside a level kinds come in order and ids in order, and the level that the cap cuts is the last."""
    if not 1 <= depth <= 4:
        raise ReadError("depth is 1 to 4")
    alive = cut_lineage(live_nodes(nodes, edges, repository))
    links = cut_lineage(edges.filter((F.col("repository_id") == repository) & F.col("type").isin(EDGE_TYPES[mode])).select("type", "src", "dst"))
    place = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    found = alive.filter(F.col("id") == anchor).withColumn("place", place).orderBy("place").limit(1).select("id", "kind").collect()
    if not found:
        raise ReadError("unknown anchor")
    if found[0]["kind"] not in STEPS[mode]:
        raise ReadError(f"{mode} does not start at a {found[0]['kind']}")
    seen, truncated = [(found[0]["id"], found[0]["kind"], 0)], False
    spark, kinds = alive.sparkSession, f"id {dict(alive.dtypes)['id']}, kind string, distance int"
    for level in range(1, depth + 1):
        frontier = [x for x in seen if x[2] == level - 1]
        if not frontier or truncated:
            break
        here = F.broadcast(spark.createDataFrame(frontier, kinds).select(F.col("id").alias("at"), F.col("kind").alias("from_kind")))  # at most ``cap`` rows
        parts = []
        for kind, steps in STEPS[mode].items():
            for types, way, reached in steps:
                for at, to in {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[way]:
                    step = links.filter(F.col("type").isin(types)).join(here.filter(F.col("from_kind") == kind), F.col(at) == F.col("at")).select("from_kind", F.col(to).alias("id"))
                    parts.append(step.join(alive.filter(F.col("kind").isin(reached)), "id"))
        done = F.broadcast(spark.createDataFrame(seen, kinds).select("id"))  # at most ``cap`` rows
        new = reduce(DataFrame.unionByName, parts).join(done, "id", "left_anti").groupBy("id", "kind").agg(F.min(F.coalesce(*[F.when(F.col("from_kind") == k, i) for i, k in enumerate(KINDS)])).alias("place"))
        rows = new.orderBy("place", "id").limit(cap - len(seen) + 1).collect()  # at most ``cap`` + 1
        truncated = len(rows) > cap - len(seen)
        seen += [(r["id"], r["kind"], level) for r in rows[: cap - len(seen)]]
    return spark.createDataFrame(seen, kinds), truncated


def evidence_edges(edges: DataFrame, assertions: DataFrame, reached: DataFrame, repository: str, mode: str = "neighborhood", cap: int = EDGES) -> tuple[DataFrame, DataFrame]:
    """(edges among the reached nodes with the file revisions of their winning assertion, one row that tells whether the cap cut them), by type, source and target."""
    ids = F.broadcast(reached.select("id"))  # capped by the walk
    own = edges.filter((F.col("repository_id") == repository) & F.col("type").isin(EDGE_TYPES[mode]))
    inside = own.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    seen = assertions.filter(F.col("repository_id") == repository).groupBy("assertion_id").agg(F.sort_array(F.collect_set("revision_id")).alias("revisions"))  # the few revisions that show one assertion
    named = inside.join(seen, "assertion_id", "left").withColumn("revisions", F.coalesce("revisions", F.array().cast(seen.schema["revisions"].dataType)))
    out = named.orderBy("type", "src", "dst").limit(cap + 1)
    return out.limit(cap), out.agg((F.count("*") > cap).alias("truncated"))


def alternatives(edges: DataFrame, assertions: DataFrame, ids: DataFrame, repository: str) -> DataFrame:
    """Assertions about the reached nodes that no edge carries: ``lower_evidence`` where a current one lost its triple, ``not_current`` otherwise."""
    own = assertions.filter(F.col("repository_id") == repository).join(ids.select(F.col("id").alias("subject")), "subject", "left_semi")
    won = edges.filter(F.col("repository_id") == repository).select(F.col("src").alias("subject"), F.col("type").alias("predicate"), F.col("dst").alias("object"), F.col("assertion_id").alias("winner"))
    held = own.select("assertion_id", "subject", "predicate", "object", "current").distinct().join(won, ["subject", "predicate", "object"], "left")
    reason = F.when(~F.col("current"), "not_current").when(F.col("winner") != F.col("assertion_id"), "lower_evidence")
    return held.withColumn("reason", reason).filter("reason is not null").select("assertion_id", "subject", "predicate", "object", "reason")


def dependency_paths(nodes: DataFrame, edges: DataFrame, repository: str, source, target, hops: int, cap: int = PATHS) -> tuple[DataFrame, DataFrame]:
    """(paths, one row that tells whether the cap cut them): directed code paths without repeated nodes, shortest first, then by their ids.

    Walked from both ends to the middle, so no level holds more than paths of half the length.
    """
    alive = live_nodes(nodes, edges, repository).filter("kind in ('file', 'symbol')").select("id")
    links = edges.filter((F.col("repository_id") == repository) & F.col("type").isin(CODE) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    links = cut_lineage(links.join(alive.select(F.col("id").alias("src")), "src", "left_semi").join(alive.select(F.col("id").alias("dst")), "dst", "left_semi"))

    def grow(walk, at, to, n):
        out = [walk]
        for _ in range(n):
            step = out[-1].join(links, F.element_at("nodes", -1) == F.col(at)).filter(~F.array_contains("nodes", F.col(to)))
            out.append(cut_lineage(step.select(F.array_append("nodes", F.col(to)).alias("nodes"))))
        return out

    start = links.sparkSession.range(1)
    kind = dict(links.dtypes)["src"]
    ahead = grow(start.select(F.array(F.lit(source).cast(kind)).alias("nodes")), "src", "dst", (hops + 1) // 2)
    behind = grow(start.select(F.array(F.lit(target).cast(kind)).alias("nodes")), "dst", "src", hops // 2)
    found = []
    for n in range(1, hops + 1):
        left, right = ahead[(n + 1) // 2].withColumn("meet", F.element_at("nodes", -1)), behind[n // 2].select(F.reverse("nodes").alias("rest"), F.element_at("nodes", -1).alias("meet"))
        both = left.join(right, "meet").filter(F.size(F.array_intersect("nodes", "rest")) == 1)
        found.append(both.select(F.concat("nodes", F.slice("rest", F.lit(2), F.size("rest"))).alias("nodes")))
    # at most the cap of each length is read on
    first = reduce(DataFrame.unionByName, [f.orderBy("nodes").limit(cap + 1) for f in found]).select("nodes", (F.size("nodes") - 1).cast("long").alias("hops"))
    out = first.orderBy("hops", "nodes").limit(cap + 1)
    return out.limit(cap), out.agg((F.count("*") > cap).alias("truncated"))


def path_evidence(paths: DataFrame, edges: DataFrame, repository: str) -> DataFrame:
    """Each edge of each path in order with its types and their greatest confidence: path, place, src, dst, types, confidence."""
    step = paths.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), "nodes", F.explode(F.sequence(F.lit(1), F.size("nodes") - 1)).alias("place"))
    ends = step.select("path", "place", F.element_at("nodes", F.col("place")).alias("src"), F.element_at("nodes", F.col("place") + 1).alias("dst"))
    own = edges.filter((F.col("repository_id") == repository) & F.col("type").isin(CODE)).groupBy("src", "dst").agg(F.sort_array(F.collect_set("type")).alias("types"), F.max("confidence").alias("confidence"))
    return ends.join(own, ["src", "dst"]).select("path", F.col("place").cast("long").alias("place"), "src", "dst", "types", "confidence")


def outgoing(nodes: DataFrame, edges: DataFrame, repository: str, anchor, cap: int = SUBJECTS) -> tuple[DataFrame, DataFrame]:
    """(IMPORTS and DEPENDS_ON edges of an anchor's subjects, one row that tells whether the subjects were cut).

    Subjects: the anchor, the files of a module, and the symbols that those files define; at most ``cap``, by id.
    """
    own = edges.filter(F.col("repository_id") == repository)
    alive = live_nodes(nodes, edges, repository)
    start = alive.filter(F.col("id") == anchor).select("id")
    files = start.unionByName(own.filter("type = 'IN_MODULE'").join(start.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")))
    files = files.join(alive.filter("kind <> 'repository'").select("id"), "id", "left_semi")
    symbols = own.filter("type = 'DEFINES'").join(files.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"))
    all_of = files.unionByName(symbols.join(alive.select("id"), "id", "left_semi")).distinct().orderBy("id").limit(cap + 1)
    subjects = all_of.orderBy("id").limit(cap)
    out = own.filter(F.col("type").isin("IMPORTS", "DEPENDS_ON")).join(F.broadcast(subjects.select(F.col("id").alias("src"))), "src").select("type", "src", "dst")  # at most ``cap`` rows
    return out, all_of.agg((F.count("*") > cap).alias("truncated"))


def revision_walk(relations: DataFrame, contains: DataFrame, anchors: DataFrame, depth: int) -> DataFrame:
    """(id, distance): undirected over the winning relations (subject, object) of a revision and its symbol-in-file containment (file_id, symbol_id)."""
    from chronofold.operators import graph

    links = relations.select(F.col("subject").alias("src"), F.col("object").alias("dst")).unionByName(contains.select(F.col("file_id").alias("src"), F.col("symbol_id").alias("dst")))
    return graph.neighbourhood(links, anchors, depth)
