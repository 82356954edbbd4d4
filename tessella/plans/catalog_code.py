"""Queries of the language tokenizers, over code that each part's name and size are written into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexers
from .catalog import Tables, query

# What each language's tokenizer gives for its template.
JAVA = "primitive identifier = number ; loop ( identifier < number ) { identifier . identifier ( string ) ; }"
PYTHON = "def identifier ( identifier ) : indent return identifier + number unindent identifier = identifier ( number )"
HASKELL = "identifier :: type -> type type identifier identifier = type ( identifier + number )"

NAME = "'x_' || replace(p_name, ' ', '_')"
TEXTS = {
    "java": f"'int ' || {NAME} || ' = ' || p_size || '; while (' || {NAME} || ' < 9) {{ ' || {NAME} || '.go(\"' || p_name || '\"); }} // end'",
    "python": f"'def ' || {NAME} || '(a):' || chr(10) || '    return a + ' || p_size || chr(10) || 'x = ' || {NAME} || '(1)' || chr(10)",
    "haskell": f"{NAME} || ' :: Int -> Maybe Int' || chr(10) || {NAME} || ' x = Just (x + ' || p_size || ')'",
}


def _code(t: Tables, language: str) -> DataFrame:
    return t.part.select("p_partkey", F.expr(TEXTS[language].replace("p_size", "string(p_size)")).alias("text"))


def _tokens_sql(language: str, kinds: str, tail: int) -> str:
    return f"SELECT p_partkey, '{kinds}' AS kinds, (length({TEXTS[language]}) - {tail})::BIGINT AS last_end FROM part"


def _tokens(t: Tables, language: str) -> DataFrame:
    rows = _code(t, language).withColumn("tokens", lexers.tokenize(F.col("text"), language))
    kinds = F.array_join(F.transform("tokens", lambda x: x["kind"]), " ")
    return rows.select("p_partkey", kinds.alias("kinds"), F.element_at("tokens", -1)["end"].alias("last_end"))


def _ranges_text(ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, lambda r: F.substring(F.col("text"), r["start"] + 1, r["end"] - r["start"])), "|")


@query("fn04_java_tokens", _tokens_sql("java", JAVA, 7))
def java_tokens(t: Tables) -> DataFrame:
    return _tokens(t, "java")


@query("fn05_python_tokens", _tokens_sql("python", PYTHON, 1))
def python_tokens(t: Tables) -> DataFrame:
    return _tokens(t, "python")


@query("fn06_haskell_tokens", _tokens_sql("haskell", HASKELL, 0))
def haskell_tokens(t: Tables) -> DataFrame:
    return _tokens(t, "haskell")


@query("fn10_java_statements", f"SELECT p_partkey, 'int ' || {NAME} || ' = ' || p_size || ';|' || {NAME} || '.go(\"' || p_name || '\");' AS statements FROM part")
def java_statements(t: Tables) -> DataFrame:
    rows = _code(t, "java").withColumn("ranges", lexers.statement_ranges(F.col("text"), "java"))
    return rows.select("p_partkey", _ranges_text(F.col("ranges")).alias("statements"))


@query("fn11_python_statements", "SELECT p_partkey, '    return a + ' || p_size || chr(10) AS statements FROM part")
def python_statements(t: Tables) -> DataFrame:
    rows = _code(t, "python").withColumn("ranges", lexers.statement_ranges(F.col("text"), "python"))
    return rows.select("p_partkey", _ranges_text(F.col("ranges")).alias("statements"))


@query("flt11_identifiers", f"SELECT p_partkey, {NAME} || ' a a x ' || {NAME} AS names FROM part")
def identifiers(t: Tables) -> DataFrame:
    rows = _code(t, "python").withColumn("tokens", lexers.tokenize(F.col("text"), "python"))
    return rows.select("p_partkey", F.array_join(lexers.identifiers(F.col("text"), F.col("tokens"), "python"), " ").alias("names"))
