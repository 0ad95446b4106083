"""Event folds to nodes and edges: one group-by a node kind, from the merge rules, so any arrival order gives the same graph.

Nodes that are only named by an edge are stubs: identity without properties.  Provenance is a table of its own (``sources``), a row for each
node and event, since a busy node may have any number of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators import merge

ORDER = ["occurred_at", "event_id"]


def routed(events: DataFrame, handles: dict[str, list[str]]) -> DataFrame:
    """Each event once for every projector that handles its type, in registry order: projector, place, and the event's columns."""
    table = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("projector"), F.array(*[F.lit(t) for t in types]).alias("types")) for i, (name, types) in enumerate(handles.items())])
    each = events.withColumn("_r", F.explode(F.filter(table, lambda x: F.array_contains(x["types"], F.col("event_type")))))
    return each.withColumns({"projector": F.col("_r.projector"), "place": F.col("_r.place").cast("long")}).drop("_r")


def node_id(kind: str, scope: Column, own: Column) -> Column:
    """``kind:<length of scope>:scope:own``; the length, in characters, keeps the pair unambiguous."""
    return F.concat(F.lit(kind + ":"), F.char_length(scope).cast("string"), F.lit(":"), scope, F.lit(":"), own)


def agent_nodes(events: DataFrame) -> DataFrame:
    """Sessions, turns and tool calls of the eight agent event types (kind, node_id, step, occurred_at, event_id, model, project_id): one row a node.

    ``step`` is one of started, stopped, output_observed, completed, ended.  Start and end are earliest times, the model is that of the newest start, the project the
    smallest named.  Earlier nodes of the chain are stubs where no event of their own came.
    """
    start = F.col("step") == "started"
    facts = events.groupBy("kind", "node_id").agg(
        merge.advance_status(F.col("step"), ORDER).alias("status"), F.min(F.when(start, F.col("occurred_at"))).alias("started_at"),
        F.min(F.when(F.col("step").isin("completed", "ended"), F.col("occurred_at"))).alias("ended_at"),
        F.max_by(F.when(start, F.col("model")), F.when(start, F.struct(*ORDER))).alias("model"), F.min("project_id").alias("project_id"), merge.disagree("project_id").alias("scope_conflict"), F.count("*").alias("n_events"),
    )
    return facts


def with_stubs(nodes: DataFrame, edges: DataFrame, ends: dict[str, str]) -> DataFrame:
    """``nodes`` (kind, node_id, ...) and an identity-only row for every end of ``edges`` (a column, its kind) that has none; ``stub`` tells."""
    named = reduce(DataFrame.unionByName, [edges.select(F.lit(kind).alias("kind"), F.col(column).alias("node_id")) for column, kind in ends.items()]).filter("node_id is not null").distinct()
    missing = named.join(nodes.select("kind", "node_id"), ["kind", "node_id"], "left_anti")
    return nodes.withColumn("stub", F.lit(False)).unionByName(missing.withColumn("stub", F.lit(True)), allowMissingColumns=True)


def merged_edges(edges: DataFrame) -> DataFrame:
    """One row for each (type, src, dst) with its first source and their number; ``sources`` of the edges gives each."""
    return edges.groupBy("type", "src", "dst").agg(F.min("event_id").alias("first_source"), F.count_distinct("event_id").alias("n_sources"))


def sources(items: DataFrame, key: list[str]) -> DataFrame:
    """Provenance: the distinct events of each item, a row each."""
    return items.select(*key, "event_id").distinct()


def newest(observations: DataFrame, key: list[str], columns: list[str], earliest: list[str]) -> DataFrame:
    """Per key the columns of its newest observation, nulls included, and the earliest of the given times."""
    return observations.groupBy(*key).agg(merge.newest_wins(columns, ORDER).alias("_n"), *[F.min(c).alias(c) for c in earliest]).select(*key, "_n.*", *earliest)


def edges_of_newest(observations: DataFrame, key: str, targets: dict[str, str], kind: str) -> DataFrame:
    """Edges (type, src, dst, dst_kind, event_id) of each key's newest observation only: what older ones named falls away, and with it stubs that nothing else names."""
    last = observations.groupBy(key).agg(merge.newest_wins(["event_id", *targets], ORDER).alias("n")).select(F.col(key).alias("src"), "n.*")
    parts = [last.filter(F.col(c).isNotNull()).select(F.lit(kind).alias("type"), "src", F.col(c).alias("dst"), F.lit(k).alias("dst_kind"), "event_id") for c, k in targets.items()]
    return reduce(DataFrame.unionByName, parts)


def supersession_of_newest(versions: DataFrame) -> DataFrame:
    """(decision_id, supersedes_id) of each decision's newest recording, if that is accepted or superseded and names one."""
    last = versions.groupBy("decision_id").agg(merge.newest_wins(["status", "supersedes_id"], ORDER).alias("v")).select("decision_id", "v.*")
    return last.filter("supersedes_id is not null and status in ('accepted', 'superseded')").select("decision_id", "supersedes_id")
