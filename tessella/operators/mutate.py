"""Source mutations, seeded, and how long a pattern is still found under them."""

from __future__ import annotations

import random
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexers import LANGUAGES
from ..plans.search import prepare, search
from ..settings import SearchSettings

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def replace_span(text: str, start: int, end: int, what: str) -> str:
    return text[:start] + what + text[end:]


def random_name(rng: random.Random, camel: bool = False) -> str:
    """1 to 20 letters, or 1 to 5 words in camel case."""
    if not camel:
        return "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 20)))
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 5))]
    return words[0] + "".join(w.capitalize() for w in words[1:])


def insert_statement(rng: random.Random, text: str, language: str, corpus: list[str]) -> str:
    """A corpus statement behind a random statement, indented like it; at the end if there is none."""
    if not corpus:
        return text
    new, spans = rng.choice(corpus), LANGUAGES[language].statements(text)
    if not spans:
        return text + new
    start, end = rng.choice(spans)
    line = text[text.rfind("\n", 0, start) + 1 :]
    margin = line[: len(line) - len(line.lstrip(" "))] if LANGUAGES[language].indented else ""
    body = "\n".join(margin + t.strip() for t in new.strip("\n").split("\n"))
    glue = "" if text[:end].endswith("\n") else "\n" if margin or LANGUAGES[language].indented else ""
    return replace_span(text, end, end, glue + body + ("\n" if LANGUAGES[language].indented else ""))


def remove_statement(rng: random.Random, text: str, language: str) -> str:
    spans = LANGUAGES[language].statements(text)
    return replace_span(text, *rng.choice(spans), "") if spans else text


def swap_statements(rng: random.Random, text: str, language: str) -> str:
    spans = LANGUAGES[language].statements(text)
    if len(spans) < 2:
        return text
    (a, b), (c, d) = sorted(rng.sample(spans, 2))
    if c < b:
        return text
    return text[:a] + text[c:d] + text[b:c] + text[a:b] + text[d:]


def names_of(text: str, language: str) -> list[str]:
    lang = LANGUAGES[language]
    return sorted({text[a:b] for k, a, b in lang.tokens(text) or [] if language == "words" or k in lang.identifiers})


def replace_identifier(rng: random.Random, text: str, language: str, new: str | None = None) -> str:
    """All places of one random identifier, from the last to the first."""
    names = names_of(text, language)
    if not names:
        return text
    old, new = rng.choice(names), new or random_name(rng, camel=True)
    lang = LANGUAGES[language]
    for kind, a, b in reversed(lang.tokens(text) or []):
        if text[a:b] == old and (language == "words" or kind in lang.identifiers):
            text = replace_span(text, a, b, new)
    return text


def insert_random(rng: random.Random, text: str, what: str) -> str:
    at = rng.randint(0, len(text))
    return replace_span(text, at, at, what)


def statement_corpus(fragments: DataFrame, language: str, text_col: str = "text") -> DataFrame:
    """(statement): of all fragments."""
    from ..functions.lexers import statement_ranges

    spans = fragments.select(text_col, F.explode(statement_ranges(F.col(text_col), language)).alias("r"))
    return spans.select(F.substring(F.col(text_col), F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("statement"))


def with_statements(fragments: DataFrame, language: str, n: int, without: list[int] | None = None) -> DataFrame:
    """Fragments of exactly n statements, less some ids."""
    from ..functions.lexers import statement_ranges

    rows = fragments.where(F.size(statement_ranges(F.col("text"), language)) == n)
    return rows.where(~F.col("frag_id").isin(without)) if without else rows


def mutate(fragments: DataFrame, language: str, mutation: Callable[[random.Random, str, str], str], steps: int, seed: int = 0) -> DataFrame:
    """(frag_id, step, text): each fragment after 1 to steps mutations; one random stream for each id."""

    def run(batches):
        for pdf in batches:
            rows = []
            for frag, text in zip(pdf.frag_id, pdf.text, strict=True):
                rng = random.Random(f"{seed}:{frag}")
                for step in range(1, steps + 1):
                    text = mutation(rng, text or "", language)
                    rows.append((frag, step, text))
            yield pd.DataFrame(rows, columns=["frag_id", "step", "text"])

    kind = fragments.schema["frag_id"].dataType.simpleString()
    return fragments.select("frag_id", "text").mapInPandas(run, f"frag_id {kind}, step int, text string")


def survival_curve(fragments: DataFrame, language: str, mutation, steps: int, presets: dict[str, SearchSettings], seed: int = 0) -> DataFrame:
    """(preset, frag_id, step, found): whether each mutated text still finds its original."""
    mutated = mutate(fragments, language, mutation, steps, seed).withColumn("query_id", F.concat_ws(":", F.col("frag_id").cast("string"), F.col("step").cast("string")))
    q = prepare(mutated, "query_id", "text", "query_id", language)
    f = prepare(fragments, "frag_id", "text", "frag_id", language)
    out = None
    for name, settings in presets.items():
        hits = search(q, f, settings, language=language).select("query_id", "frag_id").distinct().withColumn("found", F.lit(True))
        one = mutated.select("query_id", "frag_id", "step").join(hits, ["query_id", "frag_id"], "left").select(F.lit(name).alias("preset"), "frag_id", "step", F.coalesce("found", F.lit(False)).alias("found"))
        out = one if out is None else out.unionByName(one)
    return out


_BLANKS = re.compile(r"\s+")


def same_but_blanks(a: str, b: str) -> bool:
    return _BLANKS.sub("", a) == _BLANKS.sub("", b)
