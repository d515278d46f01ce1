"""Connected components by contraction: no component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component: the smallest node reachable.

    In each round a node points to its smallest neighbour or itself, pointers
    are followed twice, and edges are contracted to what the ends point to. The
    pairs of nodes still joined by an edge fall at least by half in each round.
    Each round's tables are written to the shared folder.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "pointers")
        for _ in range(2):
            onward = to.select(F.col("node").alias("to"), F.col("to").alias("onward"))
            to = to.join(onward, "to").select("node", F.col("onward").alias("to"))
        to = written(to, "pointers")
        if labels is None:
            labels = to.select("node", F.col("to").alias("component"))
        else:
            moved = to.select(F.col("node").alias("component"), "to")
            labels = written(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        e = (
            e.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        e = written(e, "edges")
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
