"""Connected components of an edge table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every greater neighbour of a node is linked to the least of
    the node and its neighbours.  Small star: the node and its lesser
    neighbours are."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    linked = near.join(least, "a")
    if large:
        linked = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        linked = linked.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
            least.select("a", F.col("_m").alias("b")))
    return linked.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long node ids to ``node, component`` (the smallest
    node that can be reached); nodes without an edge have no row.

    Alternating large and small stars: every round keeps the components and
    links nodes to lesser ones, and the table becomes one star a component
    after a number of rounds that grows with the logarithm of its diameter.
    Neighbourhoods are joined, never gathered, so a node of any degree is
    spread over tasks.  Each round is written to the shared folder.
    """
    edges = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "edges")

    def mark(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    state = mark(edges)
    while state[0]:
        edges = staged(_star(_star(edges, True), False), "edges")
        before, state = state, mark(edges)
        if before == state:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
