"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import discard, materialize, with_least


def _settled(e: DataFrame) -> bool:
    """Whether e(a, b), a < b, is of stars around their least node: no larger end has another edge."""
    ends = e.select(F.col("b").alias("node"), F.lit(1).alias("up")).union(e.select("a", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return nodes.agg(F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()[0] == 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges(a, b) of longs: the least node of each component.

    A node's neighbours are dealt over slices, so a hub is no single task's; each round is written
    to the shared folder, and edges that are stars already need none. Nodes of no edge, loops alone and null ends give no row.
    """
    e = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(e):
            break
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours link to the least of the neighbourhood.
        large = with_least(both, ["a"], "b", "low").where("b > a").select(F.least("low", "a").alias("a"), "b").distinct()
        # Small star: smaller neighbours and the node itself link to the least.
        small = with_least(large.select(F.col("b").alias("u"), F.col("a").alias("v")), ["u"], "v", "low")
        new = small.select(F.col("low").alias("a"), F.col("v").alias("b")).union(small.select(F.col("low").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        new = materialize(new, "edges")
        discard(e)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select("a", F.col("a")).distinct())
