"""Filters over the matches of a (query, fragment) group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges as R

KEY = ["query_id", "frag_id"]


#: Tokens of the query that share a cell.
CELL = 32


def remove_subsumed(matches: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Matches that no other of their group contains on both sides with as few edits; of equal ones, one.

    A match meets only those of its group that reach the cell of the query where it starts, and of
    these only such as may contain something: the group's shortest with the most edits do not.
    """
    group = Window.partitionBy(*keys)
    size = (F.col("q_end") - F.col("q_start")) + (F.col("f_end") - F.col("f_start"))
    m = matches.dropDuplicates([*keys, "q_start", "q_end", "f_start", "f_end", "dist"])
    m = m.withColumn("_cell", F.floor(F.col("q_start") / CELL))
    sized = m.withColumn("_least", F.min(size).over(group)).withColumn("_most", F.max("dist").over(group))
    held = sized.where((size > F.col("_least")) | (F.col("dist") < F.col("_most")))
    held = held.select(*keys, F.struct("q_start", "q_end", "f_start", "f_end", "dist").alias("b"), F.explode(F.sequence(F.col("_cell"), F.floor(F.col("q_end") / CELL))).alias("_cell"))
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "_cell")] + [F.col("b.b.q_start") <= F.col("a.q_start"), F.col("a.q_end") <= F.col("b.b.q_end"), F.col("b.b.f_start") <= F.col("a.f_start"), F.col("a.f_end") <= F.col("b.b.f_end"), F.col("b.b.dist") <= F.col("a.dist"), F.col("b.b") != F.struct("a.q_start", "a.q_end", "a.f_start", "a.f_end", "a.dist")]
    return m.alias("a").join(held.alias("b"), cond, "left_anti").drop("_cell")


def with_sum_length(matches: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """sum_len: summed fragment lengths of the group, overlaps counted each time."""
    return matches.withColumn("sum_len", F.sum(F.col("f_end") - F.col("f_start")).over(Window.partitionBy(*keys)))


def min_sum_length(matches: DataFrame, least: int, keys: list[str] = KEY) -> DataFrame:
    return with_sum_length(matches, keys).where(F.col("sum_len") >= least).drop("sum_len")


def min_length(matches: DataFrame, least: int) -> DataFrame:
    return matches.where(F.col("f_end") - F.col("f_start") >= least)


def group_coverage(matches: DataFrame, fragments: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, coverage): the share of the fragment's tokens under the union of its matches."""
    covered = R.coverage_rows(matches, keys, "f_start", "f_end")
    sizes = fragments.select("frag_id", F.col("n_tokens").cast("long").alias("n_tokens"))
    return covered.join(sizes, "frag_id").select(*keys, (F.col("covered") / F.col("n_tokens")).alias("coverage"))


def min_coverage(matches: DataFrame, fragments: DataFrame, least: float, keys: list[str] = KEY) -> DataFrame:
    """Matches of the groups with enough coverage, by windows: what leads to them is not computed twice."""
    sizes = fragments.select("frag_id", F.col("n_tokens").cast("long").alias("_n"))
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    rows = R.with_covered(matches.where(whole), keys, "f_start", "f_end").join(sizes, "frag_id").withColumn("coverage", F.col("covered") / F.col("_n"))
    return rows.where(F.col("coverage") >= min(max(least, 0.0), 1.0)).select(*keys, *[c for c in matches.columns if c not in keys], "coverage")


def counts(matches: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Per query: fragments with hits, groups and matches."""
    return matches.groupBy("query_id").agg(F.countDistinct("frag_id").alias("n_fragments"), F.countDistinct(*[k for k in keys if k != "query_id"]).alias("n_groups"), F.count("*").alias("n_matches"))


def nested(matches: DataFrame) -> DataFrame:
    """One row a group, its matches in an array by query start, longest first."""
    item = F.struct("q_start", (-(F.col("q_end") - F.col("q_start"))).alias("order"), "q_end", "f_start", "f_end", "dist")
    return matches.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("matches"))


def merge_shards(replies: DataFrame) -> DataFrame:
    """Partial replies (query_id, language, number, cluster_size, results) as one a query.

    Null results where languages or cluster sizes disagree.
    """
    same = (F.countDistinct("language") <= 1) & (F.countDistinct("cluster_size") <= 1)
    return replies.groupBy("query_id").agg(F.flatten(F.collect_list("results")).alias("results"), F.sum("number").alias("number"), F.max("cluster_size").alias("cluster_size"), F.max("language").alias("language"), same.alias("agree")).withColumn("results", F.when(F.col("agree"), F.col("results")))


def status(number: Column, size: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "exception").when(number.isNull(), "nothing").when(number >= size, "finished").otherwise("pending")
