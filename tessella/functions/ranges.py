"""Half-open integer ranges [start, end): as columns, as arrays of (start, end), and as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length(a: Column, b: Column) -> Column:
    return b - a


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Strictly: an empty range overlaps what it lies inside of, but not itself."""
    return ((b <= d) & (c < b)) | ((d <= b) & (a < d))


def touches(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Overlapping, or with a border in common."""
    return overlaps(a, b, c, d) | (b == c) | (a == d)


def contains(a: Column, b: Column, c: Column, d: Column) -> Column:
    """[a, b) contains [c, d)."""
    return (a <= c) & (d <= b)


def merged(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The hull of two ranges that overlap or touch, else null."""
    return F.when(touches(a, b, c, d), F.struct(F.least(a, c).alias("start"), F.greatest(b, d).alias("end")))


def cover_array(ranges: Column) -> Column:
    """Disjoint hulls of an array of ranges in any order."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (r["start"] <= last["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    plain = F.transform(ranges, lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end")))
    return F.aggregate(F.array_sort(plain), F.array().cast(kind), step)


def covered_length(ranges: Column) -> Column:
    return F.aggregate(cover_array(ranges), F.lit(0), lambda s, r: s + r["end"] - r["start"])


def coverage(ranges: Column, n: Column) -> Column:
    return covered_length(ranges) / n


def cover_rows(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): the disjoint hulls of each key's ranges, by a running maximum."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = df.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def coverage_rows(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, covered): the summed lengths of the hulls."""
    return cover_rows(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).cast("long").alias("covered"))


def with_covered(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """df with covered, the summed lengths of its key's hulls: each row adds what reaches beyond those before it."""
    group = Window.partitionBy(*keys)
    reach = F.max(end).over(group.orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    # greatest skips nulls: the first row has no reach.
    rows = df.withColumn("_new", F.greatest(F.col(end) - F.greatest(F.col(start), reach), F.lit(0)).cast("long"))
    return rows.withColumn("covered", F.sum("_new").over(group)).drop("_new")


def split_rows(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): segments between neighbouring distinct endpoints, gaps included."""
    points = df.select(*keys, F.explode(F.array(start, end)).alias(start)).distinct()
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return points.withColumn(end, following).where(F.col(end).isNotNull())


def substring_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def substrings_of(text: Column, ranges: Column) -> Column:
    """One substring for each range, in the order of the ranges."""
    return F.transform(ranges, lambda r: F.substring(text, r["start"] + 1, r["end"] - r["start"]))


def slice_of(values: Column, start: Column, end: Column) -> Column:
    """The elements of a range; null if it reaches outside."""
    return F.when((start >= 0) & (start <= end) & (end <= F.size(values)), F.slice(values, start + 1, end - start))


def numbered_lines(text: Column, start: Column, end: Column) -> Column:
    """The lines of a range as (line, text), the first padded with dots to where it starts in its line."""
    ahead = F.substring(text, 1, start)
    first = F.size(F.split(ahead, "\n", -1))
    margin = F.repeat(F.lit("."), F.length(F.element_at(F.split(ahead, "\n", -1), -1)))
    return F.transform(F.split(substring_of(text, start, end), "\n", -1), lambda t, i: F.struct((first + i).alias("line"), F.when(i == 0, F.concat(margin, t)).otherwise(t).alias("text")))


def lines_from(text: Column, line: Column, column: Column) -> Column:
    """The text from a position (line, column), both from 0, to the end."""
    lines = F.split(text, "\n", -1)
    rest = F.slice(lines, line + 2, F.greatest(F.size(lines) - line - 1, F.lit(0)))
    return F.array_join(F.concat(F.array(F.substring(F.get(lines, line), column + 1, F.length(text))), rest), "\n")


def lines_until(text: Column, line: Column, column: Column) -> Column:
    """The text up to a position, exclusive."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.concat(F.slice(lines, 1, line), F.array(F.substring(F.get(lines, line), 1, column))), "\n")


def position_inside(l0: Column, c0: Column, l1: Column, c1: Column, line: Column, column: Column) -> Column:
    """Whether a position lies in the half-open range of positions."""
    after = (line > l0) | ((line == l0) & (column >= c0))
    return after & ((line < l1) | ((line == l1) & (column < c1)))
