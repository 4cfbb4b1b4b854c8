"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import settle


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (a, b): component is its smallest reachable vertex.

    Each round maps every vertex to its smallest neighbour or itself, follows that map
    once more, and contracts the edges to the images, until none is left. Vertices at
    least halve each round, and all tables are dealt by vertex with partial minima, so no
    group is ever gathered. Rounds are settled in the shared folder, in as few tables as
    will do, since on a local disk Hadoop starts processes for every file.
    """
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("up"))
        up = low.select(F.col("id").alias("up"), F.col("up").alias("upper"))
        jump = settle(low.join(up, "up").select("id", F.col("upper").alias("to")))
        if labels is None:
            labels = jump.select("id", F.col("to").alias("component"))
        else:
            labels = settle(labels.join(jump.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        ends = edges.join(jump.select(F.col("id").alias("a"), F.col("to").alias("a2")), "a").join(jump.select(F.col("id").alias("b"), F.col("to").alias("b2")), "b")
        edges = settle(ends.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a < b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
