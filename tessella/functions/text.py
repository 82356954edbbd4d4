"""Words, identifiers, lines and edits of texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces of an identifier: two or more small letters, one that isn't last, a capital with small
#: letters, an acronym before what is no letter, or one up to the capital that starts a word.
CAMEL = r"\p{Ll}{2,}|\p{Ll}(?!$)|\p{Lu}\p{Ll}+|\p{Lu}{2,}(?=\P{L})|\p{Lu}+(?=\p{Lu})"


def words(text: Column) -> Column:
    """The fixture language: lower-cased runs of ASCII letters and digits; null stays null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def camel_split(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit(CAMEL), F.lit(0)), F.lower)


def identifier_words(name: Column) -> Column:
    """Words of an identifier: parts between underscores, split at capitals, in lower case."""
    return F.flatten(F.transform(F.filter(F.split(name, "_"), lambda p: p != ""), camel_split))


def insert_at(text: Column, at: Column, what: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at), what, F.substring(text, at + 1, F.length(text)))


def replace_range(text: Column, start: Column, end: Column, what: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), what, F.substring(text, end + 1, F.length(text)))


def delete_range(text: Column, start: Column, end: Column) -> Column:
    return replace_range(text, start, end, F.lit(""))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_starts(text: Column) -> Column:
    """Offset of each line's first character."""
    sizes = F.transform(lines(text), lambda t: F.length(t) + 1)
    sums = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return F.slice(sums, 1, F.size(sums) - 1)


def line_at(text: Column, at: Column) -> Column:
    """Number, from 0, of the line that holds a position."""
    return F.size(F.split(F.substring(text, F.lit(1), at), "\n", -1)) - 1


def is_blank(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[ \t\r\n]+", "")) == 0


def indent_of(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def indent_at(text: Column, at: Column) -> Column:
    return indent_of(F.get(lines(text), line_at(text, at)))


def least_indent(text: Column) -> Column:
    """Of the lines that aren't blank; 0 if there is none."""
    return F.coalesce(F.array_min(F.transform(F.filter(lines(text), lambda t: ~is_blank(t)), indent_of)), F.lit(0))


def indent_by(text: Column, n: Column) -> Column:
    return F.array_join(F.transform(lines(text), lambda t: F.when(is_blank(t), t).otherwise(F.concat(F.repeat(F.lit(" "), n), t))), "\n")


def unindent(text: Column) -> Column:
    by = least_indent(text)
    return F.array_join(F.transform(lines(text), lambda t: F.when(is_blank(t), t).otherwise(F.substring(t, by + 1, F.length(t)))), "\n")


def indent_to(text: Column, n: Column) -> Column:
    return indent_by(unindent(text), n)


def source_label(frag: Column, ordinal: Column) -> Column:
    """The text form of a fragment's key: "id (ordinal)"."""
    return F.concat(frag.cast("string"), F.lit(" ("), ordinal.cast("string"), F.lit(")"))


def source_key(label: Column) -> Column:
    return F.struct(F.regexp_extract(label, r"^(\d+)\D+(\d+)", 1).cast("long").alias("frag_id"), F.regexp_extract(label, r"^(\d+)\D+(\d+)", 2).cast("int").alias("ordinal"))


def with_gutter(text: Column, first: Column | None = None) -> Column:
    """Lines behind their numbers, right-aligned to the widest."""
    first = F.lit(1) if first is None else first
    rows = lines(text)
    width = F.length((F.size(rows) + first - 1).cast("string"))
    return F.array_join(F.transform(rows, lambda t, i: F.concat(F.lpad((i + first).cast("string"), width, F.lit(" ")), F.lit(" "), t)), "\n")
