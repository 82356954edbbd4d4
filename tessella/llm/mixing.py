"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Every document starts at rate 1. Under one constraint a source, that rate times size sums to the
source's target, the rates nearest to 1 in relative entropy and at most max_repeat are
min(max_repeat, exp(lambda * x)), where x is the mean size of a document's size class over the
source's scale. The convex dual separates by source: a source's Newton steps run in its own row,
over its bounded number of size classes, so all sources are solved at once and side by side. Rates
are then rounded into whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Size classes have this many steps for each doubling; so a source has a bounded number of them.
STEPS = 16
#: Documents of a class that are ranked together.
SLICE = 1_000
#: Newton steps, each inside the bracket found so far; a step out of it becomes a bisection.
ROUNDS = 80
TOLERANCE = 1e-7


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with place, from 0, in the order of key (by code point, null last): ranges are numbered side by side."""
    ranged = df.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    # One row for each range: as many as there are partitions.
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_last()))
    return ranged.withColumn("_at", inside).join(before, "_range").withColumn("place", F.col("_before") + F.col("_at") - 1).drop("_range", "_at", "_before")


def targets(sizes: DataFrame, max_repeat: int = 3, cycle: int = 3) -> DataFrame:
    """sizes(source, source_size, ...), one row for each source, with target.

    Sources by code point, null last, weigh 1 to cycle, repeating. A source gets at most
    max_repeat times its size; what that leaves is shared by weight among the others, until none
    is above.
    """
    w = materialize(numbered(sizes, "source").withColumn("_w", (F.pmod("place", F.lit(cycle)) + 1).cast("long")).drop("place"), "weights")
    cap = F.col("source_size") * max_repeat
    level, full = None, F.lit(False)
    while True:
        left, weight = w.agg(F.sum("source_size") - F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.sum(F.when(~full, F.col("_w")))).first()
        now = left / weight if weight else None
        if now is None or now == level:
            break
        level = now
        full = F.col("_w") * level > cap
    target = cap.cast("double") if level is None else F.when(full, cap.cast("double")).otherwise(F.col("_w") * level)
    return w.withColumn("target", target).drop("_w")


def solved(sources: DataFrame, max_repeat: int = 3) -> DataFrame:
    """sources(target, source_size, cells) with scale, lam (null: no finite one, all at max_repeat) and off, the relative error."""
    most = F.lit(float(max_repeat))
    mean = lambda c: c["tokens"] / c["n"]
    zero = F.struct(F.lit(0.0).alias("made"), F.lit(0.0).alias("slope"))

    def sums(lam: Column) -> Column:
        def add(acc: Column, c: Column) -> Column:
            x = mean(c) / F.col("scale")
            rate = F.exp(F.least(F.lit(50.0), lam * x))
            return F.struct((acc["made"] + c["tokens"] * F.least(most, rate)).alias("made"), (acc["slope"] + F.when(rate < most, c["tokens"] * x * rate).otherwise(0.0)).alias("slope"))

        return F.aggregate("cells", zero, add)

    def state(lam: Column, lo: Column, hi: Column, off: Column) -> Column:
        return F.struct(lam.alias("lam"), lo.alias("lo"), hi.alias("hi"), off.alias("off"))

    def moved(acc: Column, s: Column) -> Column:
        over = s["made"] > F.col("target")
        hi, lo = F.when(over, acc["lam"]).otherwise(acc["hi"]), F.when(over, acc["lo"]).otherwise(acc["lam"])
        newton = acc["lam"] + F.log(F.col("target") / s["made"]) * s["made"] / s["slope"]
        inside = (s["slope"] > 0) & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
        half = F.when(lo.isNull(), hi * 2 - 1).when(hi.isNull(), lo * 2 + 1).otherwise((lo + hi) / 2)
        off = F.abs(F.log(s["made"] / F.col("target")))
        return state(F.when(off < TOLERANCE, acc["lam"]).when(inside, newton).otherwise(half), lo, hi, off)

    def step(acc: Column, _: Column) -> Column:
        # The one-element array binds the sums, so they are computed once.
        return F.when(acc["off"] < TOLERANCE, acc).otherwise(F.transform(F.array(sums(acc["lam"])), lambda s: moved(acc, s))[0])

    none = F.lit(None).cast("double")
    scaled = sources.withColumn("scale", F.try_divide(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["tokens"] * mean(c)), "source_size"))
    solution = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(F.lit(0.0), none, none, F.lit(1.0)), step)
    open_ = (F.col("source_size") > 0) & (F.col("target") < max_repeat * F.col("source_size"))
    scaled = scaled.withColumn("s", F.when(open_, solution))
    got = materialize(scaled.select("source", "source_size", "target", "cells", "scale", F.col("s.lam").alias("lam"), F.col("s.off").alias("off")), "lambda")
    worst = got.agg(F.max("off")).first()[0]
    if worst is not None and not worst < TOLERANCE:
        raise ArithmeticError(f"Newton steps ended at a relative error of {worst}")
    return got.drop("off")


def mix_sources(sized: DataFrame, *, max_repeat: int = 3, cycle: int = 3) -> DataFrame:
    """(id, source, size, source_size, target, copies) for every row of (id, source, size).

    Copies are whole, from 0 to max_repeat, one of the two integers around the rate. Going from
    long documents to short ones, each size class of a source rounds up as many documents as bring
    the source's words nearest to what its rates ask for; inside a class a hash of the id chooses.
    The same rows always get the same copies. A document without words gets 0 copies.
    """
    kind = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * STEPS).cast("int")).otherwise(-1)
    docs = sized.select("id", "source", "size", kind.alias("kind"))
    hist = docs.groupBy("source", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    # At most STEPS classes for each doubling of the size: a bounded array for each source.
    cells = F.array_sort(F.collect_list(F.struct((-F.col("kind")).alias("order"), "n", "tokens")))
    sources = hist.groupBy("source").agg(F.sum("tokens").alias("source_size"), cells.alias("cells"))
    goals = solved(targets(sources, max_repeat, cycle), max_repeat)

    def rounded(acc: Column, c: Column) -> Column:
        mean = c["tokens"] / c["n"]
        # A source at max_repeat has no finite lambda.
        rate = F.when(c["order"] > 0, 0.0).when(F.col("lam").isNull(), float(max_repeat)).otherwise(F.least(F.lit(float(max_repeat)), F.exp(F.least(F.lit(50.0), F.col("lam") * mean / F.col("scale")))))
        base = F.floor(rate)
        want = acc["left"] + c["n"] * (rate - base) * mean
        k = F.when(rate > base, F.greatest(F.lit(0), F.least(c["n"], F.round(want / mean).cast("long")))).otherwise(F.lit(0).cast("long"))
        out = F.struct((-c["order"]).alias("kind"), c["n"].alias("n"), base.cast("long").alias("base"), k.alias("k"))
        return F.struct((want - k * mean).alias("left"), F.concat(acc["out"], F.array(out)).alias("out"))

    zero = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<kind:int,n:bigint,base:bigint,k:bigint>>").alias("out"))
    classes = goals.select("source", "source_size", "target", F.explode(F.aggregate("cells", zero, rounded)["out"]).alias("c"))
    classes = materialize(classes.select("source", "source_size", "target", "c.*", F.ceil(F.col("c.n") / SLICE).cast("int").alias("slices")), "classes")
    d = docs.alias("d").join(classes.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.kind") == F.col("c.kind")))
    d = d.select("d.id", "d.source", "size", "source_size", "target", "d.kind", "base", "k", "n", F.pmod(F.xxhash64("d.id", "size"), F.col("slices")).alias("slice"))
    some = (F.col("k") > 0) & (F.col("k") < F.col("n"))  # else all of the class are rounded alike
    share = d.where(some).groupBy("source", "kind", "slice", "k", "n").agg(F.count("*").alias("own"))
    upto = F.sum("own").over(Window.partitionBy("source", "kind").orderBy("slice"))
    share = share.select("source", "kind", "slice", (F.floor(F.col("k") * upto / F.col("n")) - F.floor(F.col("k") * (upto - F.col("own")) / F.col("n"))).alias("up"))
    rank = F.row_number().over(Window.partitionBy("source", "kind", "slice").orderBy(F.xxhash64("id", "size", F.lit(7)), "id", "size"))
    ranked = d.where(some).withColumn("rank", rank).alias("d").join(share.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.kind") == F.col("s.kind")) & (F.col("d.slice") == F.col("s.slice")))
    ranked = ranked.select("d.id", "d.source", "size", "source_size", "target", (F.col("base") + (F.col("rank") <= F.col("up")).cast("long")).alias("copies"))
    alike = d.where(~some).select("id", "source", "size", "source_size", "target", (F.col("base") + (F.col("k") > 0).cast("long")).alias("copies"))
    return ranked.unionByName(alike)


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "sized")


def op1_mix(docs: DataFrame) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it.

    Null texts have size 0, null sources form the last source; repeated rows count each.
    """
    got = mix_sources(sized_documents(docs))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take_mix(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them, with the columns they have.

    Null texts and texts without words are not taken; null sources form the last source. Where ids
    repeat or are null, rows are numbered first, so that each row, repeated or not, has copies of its own.
    """
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        got = _copies(docs, "doc_id")
        return _repeated(docs.join(got, "doc_id"), docs.columns)
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    return _repeated(rows.join(_copies(rows, "_row"), "_row"), docs.columns)


def _copies(docs: DataFrame, id_col: str) -> DataFrame:
    sized = sized_documents(docs, id_col)
    got = materialize(mix_sources(sized).where("copies > 0").select(F.col("id").alias(id_col), F.col("copies").alias("_copies")), "copies")
    discard(sized)
    return got


def _repeated(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("_copy", F.explode(F.expr("sequence(1, cast(_copies AS int))"))).select([F.col(f"`{c}`") for c in columns])
