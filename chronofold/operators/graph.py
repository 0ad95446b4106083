"""Bounded graph reads: breadth-first closures and simple paths, unrolled by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.sources.scratch import cut_lineage


def neighbourhood(edges: DataFrame, anchors: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """(id, distance) within ``depth`` hops of the anchors (column id); edges have src and dst.

    Levels are unrolled two to a plan; visited nodes are taken out by anti-join.
    """
    links = edges.select("src", "dst")
    if not directed:
        links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = cut_lineage(links.distinct())  # read once a level, made once
    seen = anchors.select("id").distinct().withColumn("distance", F.lit(0).cast("long"))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(links, frontier.id == links.src).select(F.col("dst").alias("id")).distinct()
        frontier = step.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(level).cast("long"))
        seen = seen.unionByName(frontier)
        if level % 2 == 0 and level < depth:  # each level is read twice by the next, so a long walk would double its plan at every step
            seen = cut_lineage(seen)
            frontier = seen.filter(F.col("distance") == level)
    return seen


def simple_paths(edges: DataFrame, source, target, hops: int) -> DataFrame:
    """Directed paths of at most ``hops`` edges from source to target without repeated nodes: path (ids joined by '>'), length."""
    links = cut_lineage(edges.select("src", "dst").distinct())
    walk = links.filter((F.col("src") == source) & (F.col("dst") != source)).select(F.array("src", "dst").alias("nodes"))
    found = walk
    for _ in range(hops - 1):
        ahead = walk.filter(F.element_at("nodes", -1) != target)
        walk = ahead.join(links, F.element_at("nodes", -1) == F.col("src")).filter(~F.array_contains("nodes", F.col("dst"))).select(F.array_append("nodes", F.col("dst")).alias("nodes"))
        found = found.unionByName(walk)
    return found.filter(F.element_at("nodes", -1) == target).select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), (F.size("nodes") - 1).cast("long").alias("hops"))


def chain(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Follow single successors (id -> next_id) from the starts, cycle-safe, up to ``depth`` steps: start, id, step."""
    walk = start.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("step"), F.array("id").alias("seen"))
    out = walk
    for level in range(1, depth + 1):
        walk = walk.join(links.select(F.col("id").alias("at"), "next_id"), F.col("id") == F.col("at")).filter("next_id is not null and not array_contains(seen, next_id)")
        walk = walk.select("start", F.col("next_id").alias("id"), F.lit(level).cast("long").alias("step"), F.array_append("seen", F.col("next_id")).alias("seen"))
        out = out.unionByName(walk)
    return out.select("start", "id", "step")


def closure(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every id that directed edges reach from the anchors (column id), with them: levels until no new id comes."""
    links = cut_lineage(edges.select("src", "dst").distinct())
    seen = frontier = cut_lineage(anchors.select("id").distinct())
    while not frontier.isEmpty():
        step = frontier.join(links, frontier.id == links.src).select(F.col("dst").alias("id")).distinct()
        frontier = cut_lineage(step.join(seen, "id", "left_anti"))
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def chain_both(links: DataFrame, start: DataFrame, depth: int = 50) -> DataFrame:
    """Both ways along successors (id -> next_id), cycle-safe: start, id, step (below 0 against the links), truncated.

    Levels run until none is new, ``depth`` at most a way; a start with a level beyond is marked as truncated.
    """
    ahead = cut_lineage(links.filter("next_id is not null").select(F.col("id").alias("at"), F.col("next_id").alias("to")).distinct())
    seen = own = cut_lineage(start.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("step")).distinct())
    for sign, hop in ((1, ahead), (-1, ahead.select(F.col("to").alias("at"), F.col("at").alias("to")))):
        frontier = own
        for level in range(1, depth + 2):
            step = frontier.join(hop, F.col("id") == F.col("at")).select("start", F.col("to").alias("id")).distinct()
            frontier = cut_lineage(step.join(seen, ["start", "id"], "left_anti").withColumn("step", F.lit(sign * level).cast("long")))
            if frontier.isEmpty():
                break
            seen = cut_lineage(seen.unionByName(frontier))
    over = seen.groupBy("start").agg((F.max(F.abs("step")) > depth).alias("truncated"))
    return seen.filter(F.abs("step") <= depth).join(over, "start").select("start", "id", "step", "truncated")
