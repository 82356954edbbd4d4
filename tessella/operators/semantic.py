"""Word similarity of matched groups: TF-IDF cosine over identifier words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_frequencies(docs: DataFrame, words: str = "words") -> tuple[DataFrame, DataFrame]:
    """(word, df) and a one-row table n_docs of a corpus with an array column of words."""
    terms = docs.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return terms, docs.agg(F.count("*").alias("n_docs"))


def term_counts(docs: DataFrame, id_col: str, words: str = "words") -> DataFrame:
    """(word, tf, df): occurrences and documents of each word."""
    per = docs.select(F.col(id_col).alias("d"), F.explode(words).alias("word")).groupBy("d", "word").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def cosine(groups: DataFrame, corpus: DataFrame, keys: list[str], left: str = "q_words", right: str = "f_words") -> DataFrame:
    """(keys, sim): cosine of the two word lists of each row, tf times ln((1 + N) / (1 + df)); 0 where either is empty or weightless."""
    df, n = document_frequencies(corpus)
    sides = F.concat(F.transform(left, lambda w: F.struct(w.alias("word"), F.lit(0).alias("side"))), F.transform(right, lambda w: F.struct(w.alias("word"), F.lit(1).alias("side"))))
    # A group without words has one row, of no side.
    words = groups.select(*keys, F.explode_outer(sides).alias("x"))
    both = words.groupBy(*keys, F.col("x.word").alias("word")).agg(F.count_if(F.col("x.side") == 0).alias("a"), F.count_if(F.col("x.side") == 1).alias("b"))
    # n has one row.
    weighted = both.join(df, "word", "left").crossJoin(F.broadcast(n)).withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.coalesce("df", F.lit(0)))))
    a, b = F.col("a") * F.col("idf"), F.col("b") * F.col("idf")
    sums = weighted.groupBy(*keys).agg(F.sum(a * b).alias("dot"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    sim = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("dot") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0)
    return sums.select(*keys, sim.alias("sim"))


def jaccard(groups: DataFrame, corpus: DataFrame, keys: list[str], left: str = "q_words", right: str = "f_words") -> DataFrame:
    """Another analyzer of the same form: shared distinct words over all."""
    both, any_ = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return groups.select(*keys, F.when(any_ > 0, both / any_).otherwise(0.0).alias("sim"))


def min_similarity(matches: DataFrame, groups: DataFrame, corpus: DataFrame, keys: list[str], least: float, analyzer=cosine) -> DataFrame:
    """Matches of the groups whose word lists are at least so similar."""
    return matches.join(analyzer(groups, corpus, keys).where(F.col("sim") >= least), keys)


def matched_words(groups: DataFrame, side: DataFrame, id_col: str, start: str, end: str, out: str) -> DataFrame:
    """groups(matches, an array of spans) with out: the words of the spans; side has id_col and token_words, an array of word arrays by token."""
    words = F.flatten(F.transform("matches", lambda m: F.flatten(F.slice("token_words", m[start] + 1, m[end] - m[start]))))
    return groups.join(side.select(id_col, "token_words"), id_col).withColumn(out, words).drop("token_words")
