"""Connected components by contraction, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, shared_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches; component: the smallest node reachable.

    Each round points every node at its smallest neighbour (map-side minimum, so a hub is no hot key),
    follows the pointers once more, and rewrites the edges between what is left. The smallest node of a
    component never moves, so it is the one that remains. Rounds grow with the logarithm of the longest path;
    every round's tables lie in the shared folder.
    """
    edges = shared_table(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = shared_table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")), "near")
        far = near.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = shared_table(near.join(far, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "parent")
        of = lambda k: parent.select(F.col("a").alias(k), F.col("p").alias(f"{k}p"))
        left = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("ap").alias("a"), F.col("bp").alias("b")).where("a <> b")
        rest = shared_table(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("a").alias("component"), F.col("p").alias("next"))
            labels = shared_table(labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
        discard(edges, near)
        edges = rest
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
