"""Block structure of matches: depth relations, accordance, maximal cliques."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delimiters(kinds: Column, opens: str, closes: str) -> Column:
    """Array of (pos, step): 1 where a block opens, -1 where one closes."""
    all_ = F.transform(kinds, lambda k, i: F.struct(i.alias("pos"), F.when(k == opens, 1).when(k == closes, -1).otherwise(0).alias("step")))
    return F.filter(all_, lambda d: d["step"] != 0)


def clamp(at: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(at, n - 1))


def relation(delims: Column, a: Column, b: Column, n: Column) -> Column:
    """(up, down) between two positions: blocks closed on the way count down, those opened and still open up."""
    low, high = F.least(clamp(a, n), clamp(b, n)), F.greatest(clamp(a, n), clamp(b, n))
    own = F.filter(delims, lambda d: (d["pos"] >= low) & (d["pos"] < high))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    walk = F.aggregate(own, zero, lambda s, d: F.struct((s["depth"] + d["step"]).alias("depth"), F.least(s["least"], s["depth"] + d["step"]).alias("least")))
    return F.struct((walk["depth"] - walk["least"]).alias("up"), (-walk["least"]).alias("down"))


def flat_relation() -> Column:
    """For languages without blocks: everything stands in one."""
    return F.struct(F.lit(0).alias("up"), F.lit(0).alias("down"))


def delimiter_string(kinds: Column, start: Column, end: Column, opens: str, closes: str) -> Column:
    """The delimiters in a range, in order, as signs."""
    part = F.slice(kinds, start + 1, end - start)
    return F.array_join(F.transform(F.filter(part, lambda k: k.isin(opens, closes)), lambda k: F.when(k == opens, "+").otherwise("-")), "")


def accordant_pairs(matches: DataFrame, queries: DataFrame, fragments: DataFrame, *, flat: bool = False) -> DataFrame:
    """(query_id, frag_id, a, b): numbers of matches of a group that agree.

    They overlap on neither side, and their starts stand in the same block relation on both.
    matches has a number n in its group; queries and fragments have delims and n_tokens.
    """
    m = matches.select("query_id", "frag_id", "n", "q_start", "q_end", "f_start", "f_end")
    pairs = m.alias("a").join(m.alias("b"), (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.frag_id") == F.col("b.frag_id")) & (F.col("a.n") < F.col("b.n")) & _apart("q") & _apart("f"))
    pairs = pairs.select("a.query_id", "a.frag_id", F.col("a.n").alias("a"), F.col("b.n").alias("b"), F.col("a.q_start").alias("qa"), F.col("b.q_start").alias("qb"), F.col("a.f_start").alias("fa"), F.col("b.f_start").alias("fb"))
    if not flat:
        pairs = pairs.join(queries.select("query_id", F.col("delims").alias("qd"), F.col("n_tokens").alias("qn")), "query_id").join(fragments.select("frag_id", F.col("delims").alias("fd"), F.col("n_tokens").alias("fn")), "frag_id")
        pairs = pairs.where(relation(F.col("qd"), F.col("qa"), F.col("qb"), F.col("qn")) == relation(F.col("fd"), F.col("fa"), F.col("fb"), F.col("fn")))
    return pairs.select("query_id", "frag_id", "a", "b")


def _apart(side: str) -> Column:
    return (F.col(f"a.{side}_end") <= F.col(f"b.{side}_start")) | (F.col(f"b.{side}_end") <= F.col(f"a.{side}_start"))


def maximal_cliques(nodes: list[int], edges: set[tuple[int, int]]) -> list[list[int]]:
    """All maximal cliques of a small graph, sorted; Bron and Kerbosch with a pivot."""
    near: dict[int, set[int]] = {n: set() for n in nodes}
    for a, b in edges:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    out: list[list[int]] = []
    stack = [(frozenset(), set(nodes), set())]
    while stack:
        held, open_, done = stack.pop()
        if not open_ and not done:
            if held:
                out.append(sorted(held))
            continue
        pivot = max(open_ | done, key=lambda v: len(near[v] & open_))
        for v in sorted(open_ - near[pivot]):
            stack.append((held | {v}, open_ & near[v], done & near[v]))
            open_ = open_ - {v}
            done = done | {v}
    return sorted(out)


def pairs_of(members: Column | str) -> Column:
    """Array of (a, b), a < b: all pairs of an array of distinct values."""
    held = F.array_sort(members)
    return F.flatten(F.transform(held, lambda x, i: F.transform(F.slice(held, i + 2, F.size(held)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def graph_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b, once each: loops and ends outside of nodes(node) are dropped."""
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if nodes is not None:
        for end in ("a", "b"):
            e = e.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return e


def connected(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(a, b) with connected: whether an edge links the two, in either direction."""
    ends = [F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")]
    e = edges.select(*ends).distinct().withColumn("_e", F.lit(True))
    return pairs.select("*", *ends).join(e, ["_x", "_y"], "left").withColumn("connected", F.coalesce("_e", F.lit(False))).drop("_x", "_y", "_e")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour) in both directions."""
    ends = [F.struct(F.col(x).alias("node"), F.col(y).alias("neighbour")) for x, y in ("ab", "ba")]
    return edges.select(F.explode(F.array(*ends)).alias("x")).select("x.*").where("node <> neighbour").distinct()


def clique_groups(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """matches with group_id: each maximal clique of a group's accordant matches; a match may be in several.

    Groups of one match, or without pairs, need no Python; others go to it one group at a time.
    """
    keys = ["query_id", "frag_id"]
    linked = pairs.select(*keys).distinct()
    easy = matches.join(linked, keys, "left_anti").withColumn("group_id", F.col("n").cast("int"))
    hard = matches.join(linked, keys, "left_semi")
    sides = hard.select(*keys, F.col("n").alias("a"), F.lit(None).cast(matches.schema["n"].dataType).alias("b")).unionByName(pairs.select(*keys, "a", "b"))

    def cliques(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf.loc[pdf.b.isna(), "a"].astype(int).tolist()
        edges = {(int(a), int(b)) for a, b in pdf.loc[pdf.b.notna(), ["a", "b"]].itertuples(index=False)}
        rows = [(pdf.query_id.iloc[0], pdf.frag_id.iloc[0], n, g) for g, members in enumerate(maximal_cliques(nodes, edges)) for n in members]
        return pd.DataFrame(rows, columns=["query_id", "frag_id", "n", "group_id"])

    kind = {c: matches.schema[c].dataType.simpleString() for c in (*keys, "n")}
    found = sides.groupBy(*keys).applyInPandas(cliques, f"query_id {kind['query_id']}, frag_id {kind['frag_id']}, n {kind['n']}, group_id int")
    return easy.unionByName(hard.join(found, [*keys, "n"]).select(easy.columns))


def block_groups(matches: DataFrame, queries: DataFrame, fragments: DataFrame, *, flat: bool = False) -> DataFrame:
    """matches numbered in their group and split into accordant groups."""
    number = F.row_number().over(Window.partitionBy("query_id", "frag_id").orderBy("q_start", F.desc("q_end"), "f_start", "f_end")) - 1
    m = matches.withColumn("n", number)
    return clique_groups(m, accordant_pairs(m, queries, fragments, flat=flat))


def cliques_brute_force(nodes: list[int], edges: set[tuple[int, int]]) -> list[list[int]]:
    """By trying all subsets; for tests."""
    linked = {frozenset(e) for e in edges if e[0] != e[1]}
    sets = [set(c) for k in range(1, len(nodes) + 1) for c in combinations(sorted(nodes), k) if all(frozenset(p) in linked for p in combinations(c, 2))]
    return sorted(sorted(s) for s in sets if not any(s < t for t in sets))
