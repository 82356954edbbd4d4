"""Results as messages, sites and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions.text import source_label

MISSING = "<missing fragment>"


def span(a: Column, b: Column) -> Column:
    return F.struct(a.alias("rangeStart"), b.alias("rangeEnd"))


def with_texts(results: DataFrame, fragments: DataFrame) -> DataFrame:
    """results with the fragment's text, a placeholder where it is missing."""
    return results.join(fragments.select("frag_id", F.col("text").alias("fragment_text")), "frag_id", "left").withColumn("fragment_text", F.coalesce("fragment_text", F.lit(MISSING)))


def for_display(results: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Results with their answer and its question; those without either are dropped."""
    a = answers.select(F.col("id").alias("frag_id"), F.col("parent").alias("question_id"), F.col("rating").alias("answer_rating"))
    q = questions.select(F.col("id").alias("question_id"), "title", F.col("rating").alias("question_rating"))
    return results.join(a, "frag_id").join(q, "question_id")


def match_messages(matches: DataFrame, *, end_of_last: bool = True) -> DataFrame:
    """(query_id, frag_id, group_id, source, matches): one row a group; needs f_text and q_text offsets as q_txt_start...

    end_of_last False ends the pattern's text range where its last token starts.
    """
    f_end = F.col("f_txt_end") if end_of_last else F.col("f_txt_last")
    one = F.struct(F.col("q_start").alias("order"), F.col("dist").alias("levenScore"), span(F.col("f_txt_start"), f_end).alias("patternTextRange"), span(F.col("f_start"), F.col("f_end")).alias("patternTokenRange"), span(F.col("q_txt_start"), F.col("q_txt_end")).alias("queryTextRange"), span(F.col("q_start"), F.col("q_end")).alias("queryTokenRange"))
    rows = matches.groupBy("query_id", "frag_id", "group_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda m: m.dropFields("order")).alias("matches"))
    return rows.withColumn("source", source_label(F.col("frag_id"), F.col("group_id")))


def sites(matches: DataFrame, fragments: DataFrame) -> DataFrame:
    """(query_id, site, frag_id, coverage, sum_len): results grouped by their set of query ranges."""
    ranges = F.array_sort(F.collect_set(F.struct("q_start", "q_end")))
    rows = matches.groupBy("query_id", "frag_id").agg(ranges.alias("ranges"), F.collect_list(F.struct(F.col("f_start").alias("start"), F.col("f_end").alias("end"))).alias("f"), F.sum(F.col("f_end") - F.col("f_start")).alias("sum_len"))
    rows = rows.join(fragments.select("frag_id", "n_tokens"), "frag_id").withColumn("coverage", R.coverage(F.col("f"), F.col("n_tokens")))
    text = F.array_join(F.transform("ranges", lambda r: F.concat(r["q_start"].cast("string"), F.lit("-"), r["q_end"].cast("string"))), ",")
    return rows.select("query_id", text.alias("site"), "frag_id", "coverage", "sum_len")


def rank_sites(site_rows: DataFrame) -> DataFrame:
    """(query_id, site, n_results, score, rank): mean coverage times mean length over the largest mean length of the query."""
    s = site_rows.groupBy("query_id", "site").agg(F.count("*").alias("n_results"), F.avg("coverage").alias("cov"), F.avg("sum_len").alias("len"))
    s = s.withColumn("score", F.col("cov") * F.col("len") / F.max("len").over(Window.partitionBy("query_id")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "site"))
    return s.select("query_id", "site", "n_results", "score", rank.alias("rank"))


def first_of_each(site_rows: DataFrame, shown: int = 3) -> DataFrame:
    """The first results of each site by coverage, with the number of others."""
    site = Window.partitionBy("query_id", "site")
    place = F.row_number().over(site.orderBy(F.desc("coverage"), "frag_id"))
    rows = site_rows.withColumn("place", place).withColumn("others", F.greatest(F.count("*").over(site) - shown, F.lit(0)))
    return rows.where(F.col("place") <= shown)


def by_coverage(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("coverage"), "query_id", "frag_id")


def by_question_rating(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("question_rating"), "query_id", "frag_id")
