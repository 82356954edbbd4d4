"""Statistics of a survey of files against an index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges as R

#: Weight of the relative frequency in the combined score.
FREQUENCY_WEIGHT = 0.002
LEAST_TAG_COUNT = 100
LEAST_SAMPLE_COUNT = 20
LEAST_PATTERN_TOKENS = 30


def relevant(matches: DataFrame, keys: list[str], more_than: int = LEAST_PATTERN_TOKENS) -> DataFrame:
    """Matches of results whose pattern tokens sum to more than a number."""
    total = F.sum(F.col("f_end") - F.col("f_start")).over(Window.partitionBy(*keys))
    return matches.withColumn("_t", total).where(F.col("_t") > more_than).drop("_t")


def file_coverage(matches: DataFrame, files: DataFrame) -> DataFrame:
    """(path, coverage, length): share of each file's text under any match; files without a match have 0."""
    covered = R.coverage_rows(matches.select("path", F.col("q_txt_start").alias("start"), F.col("q_txt_end").alias("end")), ["path"])
    return files.join(covered, "path", "left").select("path", (F.coalesce("covered", F.lit(0)) / F.col("length")).alias("coverage"), "length")


def weighted_mean_coverage(per_file: DataFrame) -> DataFrame:
    """One row: mean coverage weighted by length over the largest length."""
    w = per_file.crossJoin(F.broadcast(per_file.agg(F.max("length").alias("most"))))
    return w.agg((F.sum(F.col("coverage") * F.col("length") / F.col("most")) / F.sum(F.col("length") / F.col("most"))).alias("mean_coverage"))


def is_verbatim(a: Column, b: Column) -> Column:
    """Equal but for blanks."""
    return F.filter(F.split(a, r"\s+"), lambda w: w != "") == F.filter(F.split(b, r"\s+"), lambda w: w != "")


def verbatim_counts(results: DataFrame) -> DataFrame:
    """(path, copies) from (path, result, query_text, pattern_text): results whose matches are all verbatim."""
    per = results.groupBy("path", "result").agg(F.bool_and(is_verbatim(F.col("query_text"), F.col("pattern_text"))).alias("copy"))
    return per.groupBy("path").agg(F.count_if("copy").alias("copies"))


def source_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("frag_id").agg(F.count("*").alias("n"))


def tag_counts(questions: DataFrame, tag: str, more_than: int = LEAST_TAG_COUNT) -> DataFrame:
    """(tag, n): tags beside a given one, that occur more often than a number."""
    return questions.where(F.array_contains("tags", tag)).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def sample_tag_counts(counts: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, n): summed counts of the sources under each tag; tags has frag_id and tags."""
    return counts.join(tags, "frag_id").select(F.explode("tags").alias("tag"), "n").groupBy("tag").agg(F.sum("n").alias("n"))


def relative_frequency(counts: DataFrame) -> DataFrame:
    """freq: count over the largest count."""
    return counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most")))).withColumn("freq", F.col("n") / F.col("most"))


def relative_representation(sample: DataFrame, population: DataFrame) -> DataFrame:
    """(tag, representation): product of the two relative frequencies."""
    a, b = relative_frequency(sample).select("tag", F.col("freq").alias("a")), relative_frequency(population).select("tag", F.col("freq").alias("b"))
    return a.join(b, "tag").select("tag", (F.col("a") * F.col("b")).alias("representation"))


def erf(z: Column) -> Column:
    """The error function as a column: a series of positive terms, beyond which 6.5 is as good as any number."""
    x = F.least(F.abs(z.cast("double")), F.lit(6.5))
    first = x * (2 / math.sqrt(math.pi))

    def term(acc: Column, n: Column) -> Column:
        now = acc["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(now.alias("term"), (acc["total"] + now).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), F.struct(first.alias("term"), first.alias("total")), term)["total"]
    return F.when(F.isnan(z) | z.isNull(), None).otherwise(F.sign(z) * F.exp(-x * x) * total)


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def chi_square_cdf(x: Column) -> Column:
    """Of one degree of freedom."""
    return erf(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def normal_score(sample: DataFrame, population: DataFrame, more_than: int = LEAST_SAMPLE_COUNT, *, corrected: bool = False) -> DataFrame:
    """(tag, score): how far up a tag's count lies under a normal law of the population's share.

    The spread is n p (1 - p), which is the variance; corrected takes its root. A share of 1 scores 1.
    """
    s = sample.crossJoin(F.broadcast(sample.agg(F.max("n").alias("total")))).where(F.col("n") > more_than)
    p = relative_frequency(population).select("tag", F.col("freq").alias("p"))
    j = s.join(p, "tag")
    spread = F.col("total") * F.col("p") * (1 - F.col("p"))
    spread = F.sqrt(spread) if corrected else spread
    z = (F.col("n") - F.col("total") * F.col("p")) / F.when(spread > 0, spread)
    return j.select("tag", F.when(F.col("p") >= 1, 1.0).otherwise(normal_cdf(z.cast("double"))).alias("score"))


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Statistic of the table ((a, b), (c, d)), in doubles; 0 where a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins > 0, (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / F.when(margins > 0, margins)).otherwise(0.0)


def chi_square_score(sample: DataFrame, population: DataFrame) -> DataFrame:
    """(tag, score): 0 to 1, above one half where the tag is more frequent in the sample."""
    s = sample.crossJoin(F.broadcast(sample.agg(F.max("n").alias("sn")))).select("tag", F.col("n").alias("a"), "sn")
    p = population.crossJoin(F.broadcast(population.agg(F.max("n").alias("pn")))).select("tag", F.col("n").alias("c"), "pn")
    j = s.join(p, "tag")
    x = chi_square(F.col("a"), F.col("sn") - F.col("a"), F.col("c"), F.col("pn") - F.col("c"))
    up = F.col("a") * F.col("pn") >= F.col("c") * F.col("sn")
    q = chi_square_cdf(x)
    return j.select("tag", x.alias("statistic"), F.when(up, 0.5 + q / 2).otherwise(0.5 - q / 2).alias("score"))


def combined_score(sample: DataFrame, population: DataFrame, more_than: int = LEAST_SAMPLE_COUNT) -> DataFrame:
    f = relative_frequency(sample).select("tag", "freq")
    return normal_score(sample, population, more_than).join(f, "tag").select("tag", (F.col("score") + FREQUENCY_WEIGHT * F.col("freq")).alias("score"))


def survival(results: DataFrame) -> DataFrame:
    """(preset, step, fraction): share of mutated patterns still found."""
    return results.groupBy("preset", "step").agg(F.avg(F.col("found").cast("double")).alias("fraction"))


def write_report(df: DataFrame, path: str) -> None:
    """Semicolon-separated text."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
