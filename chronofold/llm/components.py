"""Connected components by repeated contraction, without collecting anything.

Each round every node points at the smallest of itself and its neighbours, pointers are followed once more, and the
edges are rewritten to the pointed-at nodes; loops and repeats fall away.  A round's result is a written
table.  Minima are map-side combined, and the joins put an exchange directly below both sides, so
adaptive execution may split a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is one node of the component.

    Loops and repeated edges are allowed; no edges give no rows.  Nodes without an edge are not returned.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        # p(p(x)): one jump; a parent is always a node of the graph
        second = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jumped = materialise(parent.join(second, "p").select("a", F.col("q").alias("p")), "jumped")
        to = jumped.select(F.col("a").alias("x"), "p")
        moved = (
            edges.join(to, edges.a == to.x).select(F.col("p").alias("a"), "b")
            .join(to.withColumnRenamed("p", "p2"), F.col("b") == F.col("x")).select("a", F.col("p2").alias("b"))
            .filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        next_edges = materialise(moved, "edges")
        next_labels = materialise(
            labels.join(to, labels.root == to.x, "left").select("node", F.coalesce("p", "root").alias("root")), "labels"
        )
        for old in (edges, labels, parent, jumped):
            discard(old)
        edges, labels = next_edges, next_labels
    return labels
