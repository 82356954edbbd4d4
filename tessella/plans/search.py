"""The whole search as one logical plan over any number of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexers, text
from ..operators import aggregate as A
from ..operators import align, blocks, semantic
from ..session import spread
from ..settings import SearchSettings


def prepare(docs: DataFrame, id_col: str, text_col: str, out_id: str, language: str = "words") -> DataFrame:
    """(out_id, text, tokens, n_tokens, spans, delims, token_words): what a search needs of each document.

    tokens is the array that is aligned: words themselves, or token kinds. Documents that the
    tokenizer refuses, null texts included, are left out.
    """
    rows = docs.select(F.col(id_col).alias(out_id), F.col(text_col).alias("text"))
    rows = rows if rows.isStreaming else spread(rows)
    if language == "words":
        out = rows.where(F.col("text").isNotNull()).withColumn("tokens", text.words(F.col("text")))
        return out.select("*", F.size("tokens").alias("n_tokens"), F.lit(None).cast(lexers.TOKENS_TYPE).alias("spans"), F.array().cast("array<struct<pos:int,step:int>>").alias("delims"), F.transform("tokens", lambda w: F.array(w)).alias("token_words"))
    lang = lexers.LANGUAGES[language]
    out = rows.withColumn("spans", lexers.tokenize(F.col("text"), language)).where(F.col("spans").isNotNull())
    out = out.withColumn("tokens", F.transform("spans", lambda t: t["kind"])).withColumn("n_tokens", F.size("tokens"))
    delims = blocks.delimiters(F.col("tokens"), lang.opens, lang.closes) if lang.opens else F.array().cast("array<struct<pos:int,step:int>>")
    own = sorted(lang.identifiers)
    names = F.transform("spans", lambda t: F.when(t["kind"].isin(own), text.identifier_words(F.substring(F.col("text"), t["start"] + 1, t["end"] - t["start"]))).otherwise(F.array().cast("array<string>")))
    return out.withColumn("delims", delims).withColumn("token_words", names)


def refine(matches: DataFrame, fragments: DataFrame, settings: SearchSettings, keys: list[str] = A.KEY) -> DataFrame:
    """Matches of the groups with enough total length and coverage."""
    return A.min_coverage(A.min_sum_length(matches, settings.min_sum, keys), fragments, settings.coverage, keys)


def search(queries: DataFrame, fragments: DataFrame, settings: SearchSettings, *, language: str = "words", corpus: DataFrame | None = None, skip_self: bool = False, no_repeats: bool = False, analyzer=semantic.cosine) -> DataFrame:
    """Matches of prepared queries and fragments that pass the settings, with group_id and coverage.

    One row for each match; a fragment has several groups if its matches disagree in block
    structure. corpus (an array column words) weighs the words; the fragments by default. no_repeats keeps
    repeated passages of a query from meeting a fragment once each.
    """
    found = align.fuzzy_matches(queries, fragments, settings.min_match, settings.distance) if settings.distance else align.exact_matches(queries, fragments, settings.min_match, skip_self=skip_self, no_repeats=no_repeats)
    if skip_self:
        found = found.where("query_id <> frag_id")
    # Length and coverage before subsumption are implied by those after it.
    out = refine(A.remove_subsumed(found), fragments, settings)
    keys = A.KEY
    if settings.blocks:
        flat = language == "words" or not lexers.LANGUAGES[language].opens
        keys = [*A.KEY, "group_id"]
        out = refine(blocks.block_groups(out.drop("coverage"), queries, fragments, flat=flat).drop("n"), fragments, settings, keys)
    else:
        out = out.withColumn("group_id", F.lit(0))
    if settings.semantic is not None:
        keys = [*A.KEY, "group_id"]
        held = [c for c in out.columns if c not in keys]
        # One shuffle of the matches serves their words and the result.
        groups = out.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct(*held)).alias("matches"))
        both = semantic.matched_words(groups, fragments, "frag_id", "f_start", "f_end", "f_words")
        if language == "words" and not settings.distance:
            # Equal tokens are equal words: the texts of the queries need not be read again.
            both = both.withColumn("q_words", F.col("f_words"))
        else:
            both = semantic.matched_words(both, queries, "query_id", "q_start", "q_end", "q_words")
        words = corpus if corpus is not None else fragments.select(F.flatten("token_words").alias("words"))
        near = semantic.min_similarity(groups, both.drop("matches"), words, keys, settings.semantic, analyzer)
        out = near.select(*keys, F.explode("matches").alias("m"), "sim").select(*keys, *[F.col(f"m.{c}").alias(c) for c in held], "sim")
    return out
