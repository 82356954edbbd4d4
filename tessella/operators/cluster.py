"""Clusters of patterns that contain each other: strongly connected components of a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.search import search
from ..settings import SearchSettings


def pattern_links(patterns: DataFrame, settings: SearchSettings) -> DataFrame:
    """(a, b): pattern a, as a query, finds pattern b; each pattern is both."""
    queries = patterns.withColumnRenamed("frag_id", "query_id")
    return search(queries, patterns, settings, skip_self=True).select(F.col("query_id").alias("a"), F.col("frag_id").alias("b")).distinct()


def reachable(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(a, b): a leads to b in one step or more. Path lengths double each round."""
    paths = edges.select("a", "b").where("a <> b").distinct()
    size = -1
    for _ in range(most_rounds):
        now = paths.count()
        if now == size:
            return paths
        size = now
        onward = paths.alias("x").join(paths.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).where("a <> b")
        paths = _kept(paths.union(onward).distinct())
    raise RuntimeError(f"paths did not settle in {most_rounds} rounds")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cluster_id, cluster_size): nodes that reach each other; the id is the least of them.

    First weak links fall away: a node without an incoming or outgoing edge is alone, round by
    round; only cyclic parts are closed transitively.
    """
    e = _kept(edges.where("a <> b").select("a", "b").distinct())
    while True:
        inner = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        inner = _kept(inner)
        if inner.count() == e.count():
            break
        e = inner
    paths = reachable(e)
    mutual = paths.join(paths.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])
    least = mutual.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    out = nodes.select("node").join(least, "node", "left").select("node", F.least("node", F.coalesce("m", "node")).alias("cluster_id"))
    return out.join(out.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")), "cluster_id").select("node", "cluster_id", "cluster_size")


def cluster_patterns(patterns: DataFrame, settings: SearchSettings) -> DataFrame:
    return strong_components(patterns.select(F.col("frag_id").alias("node")), pattern_links(patterns, settings))


def assign_clusters(results: DataFrame, clusters: DataFrame) -> DataFrame:
    """results with cluster_id; fragments of no cluster have their own id."""
    return results.join(clusters.select(F.col("node").alias("frag_id"), "cluster_id"), "frag_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "frag_id"))


def _kept(df: DataFrame) -> DataFrame:
    """Lineage cut by a checkpoint in the shared folder; without one, the plan as it is, cached."""
    sc = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.cache()
