"""Tokenizers of programming languages, as Arrow UDFs that give (kind, start, end) arrays.

Rules are ordered: the first that matches wins, whatever would match longer. Positions count code
points. Each language has one compiled alternation of named rules; Python adds a machine for
logical lines and indentation.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS_TYPE = "array<struct<kind:string,start:int,end:int>>"
Token = tuple[str, int, int]

# Literals and comments that languages share.
STRING = r'"(?:[^"\\]|\\.|\\$)*"'
CHAR = r"'(?:[^'\\]|\\.|\\$)*'"
BLOCK_COMMENT = r"/\*(?:[\s\S]*?\*/|[\s\S]*$)"
NUMBER = r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"

# Java words by kind, in the order in which they are tried.
JAVA_WORDS = [
    ("break", "break"),
    ("import", "import"),
    ("return", "return"),
    ("modifier", "public private protected static final volatile"),
    ("loop", "do while for"),
    ("condition", "if else switch case"),
    ("structure", "class interface"),
    ("keyword", "package null throw try catch finally throws super this new continue goto synchronized enum assert"),
    ("boolean", "true false"),
    ("primitive", "byte char short int long float double boolean void"),
]
# Java signs, in the order in which they are tried.
JAVA_SIGNS = "< > == = ! & | + * - / % ( ) [ ] { } . , : ? ;".split()
# Python signs and words, in the order in which they are tried; words need no boundary.
PYTHON_SIGNS = "< > == = != : ; , . + - ** * / % & | ( ) [ ] { } ^ \\ ~".split()
PYTHON_WORDS = "not and in is or class import if else elif try except finally raise as with def pass yield return".split()
# Haskell words and operators.
HASKELL_WORDS = set("if then else let in do where class data default module import infix infixl infixr type newtype instance case of _".split())
HASKELL_OPERATORS = set("-> <- @ | * / + - :: => == \\ = /= . <$> <*> >>= :".split())


def _word_rules() -> str:
    """Java words: within a kind the first that fits is tried alone, and needs no letter or digit behind it."""
    out = []
    for kind, words in JAVA_WORDS:
        tried: list[str] = []
        for w in words.split():
            # A word behind a shorter one that starts it is never reached.
            if not any(w.startswith(t) for t in tried):
                tried.append(w)
        if kind == "boolean":
            out[-1:] = [out[-1], rf"(?P<boolean>(?:{'|'.join(tried)})(?![^\W_]))"]
        else:
            out.append(rf"(?P<{kind}>(?:{'|'.join(tried)})(?![^\W_]))")
    return "|".join(out)


_JAVA_NAME = r"(?:[^\W\d]|[$])(?:\w|[$])*"
_JAVA = re.compile(
    rf"(?P<skip>\s+|//[^\r\n]*|{BLOCK_COMMENT})|(?P<sign>{'|'.join(map(re.escape, JAVA_SIGNS))})|{_word_rules()}"
    rf"|(?P<number>0x[0-9a-f]+|{NUMBER}[df]?)|(?P<label>{_JAVA_NAME}\x20*:)|(?P<identifier>{_JAVA_NAME})|(?P<string>{STRING})|(?P<char>{CHAR})|(?P<annotation>@{_JAVA_NAME})"
)


def java_tokens(text: str) -> list[Token]:
    """Up to the first character that no rule takes; import statements are left out."""
    out: list[Token] = []
    at, dropping = 0, False
    while m := _JAVA.match(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "skip":
            continue
        if kind == "sign":
            kind = m[0]
        if kind == "import":
            dropping = True
        if not dropping:
            out.append((kind, m.start(), at))
        elif kind == ";":
            dropping = False
    return out


_PY = re.compile(
    rf"(?P<skip>#[^\r\n]*|[ \t]+)|(?P<eol>[\r\n]+)|(?P<sign>{'|'.join(map(re.escape, PYTHON_SIGNS))})|(?P<word>{'|'.join(PYTHON_WORDS)})|(?P<loop>for|while)"
    rf"|(?P<string>'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|'(?:[^'\\]|\\[\s\S])*'|\"(?:[^\"\\]|\\[\s\S])*\")|(?P<number>{NUMBER})|(?P<identifier>[^\W\d]\w*|_\w*)|(?P<decorator>@(?:[^\W\d]|_)\w*)"
)
_NO_TOKEN = ("skip", "eol", "joint")


def _python_pieces(text: str) -> list[Token] | None:
    """The whole text as (kind, start, end), with blanks, comments and line ends; None where nothing fits.

    A backslash before a line end is a joint.
    """
    out: list[Token] = []
    at = 0
    while at < len(text):
        if not (m := _PY.match(text, at)):
            return None
        kind = m[0] if m.lastgroup in ("sign", "word") else m.lastgroup
        if kind == "eol" and out and out[-1][0] == "\\":
            out[-1] = ("joint", *out[-1][1:])
        out.append((kind, at, m.end()))
        at = m.end()
    return out


def _logical_lines(pieces: list[Token]) -> list[list[Token]] | None:
    """Pieces cut behind each line end that no joint or open bracket carries over; None if the text ends in one."""
    lines: list[list[Token]] = [[]]
    depth = 0
    for piece in pieces:
        lines[-1].append(piece)
        kind = piece[0]
        if kind in ("(", "[", "{"):
            depth += 1
        elif kind in (")", "]", "}"):
            depth -= 1
        elif kind == "eol" and depth <= 0 and "joint" not in (p[0] for p in lines[-1][-2:-1]):
            lines.append([])
    if len(lines) > 1 and not lines[-1]:
        lines.pop()
    elif lines[-1] and lines[-1][-1][0] != "eol" and (depth > 0 or lines[-1][-1][0] == "\\"):
        return None
    return lines


def python_layout(text: str) -> list[tuple[int, int, list[Token]]] | None:
    """(start, end, tokens) of each logical line, with indent and unindent; leading tabs count four everywhere."""
    pieces = _python_pieces(text)
    lines = None if pieces is None else _logical_lines(pieces)
    if lines is None:
        return None
    margins, shift, out = [0], 0, []
    for line in lines:
        if not line:
            return [(0, 0, [])]
        start, tokens = line[0][1], [p for p in line if p[0] not in _NO_TOKEN]
        lead = text[start : line[0][2]]
        width = 0 if lead.strip(" \t") else len(lead) + 3 * lead.count("\t")
        marks: list[str] = []
        if tokens and width > margins[-1]:
            margins.append(width)
            marks = ["indent"]
        elif tokens and width in margins:
            marks = ["unindent"] * (len(margins) - 1 - margins.index(width))
            margins = margins[: len(margins) - len(marks)]
        begin = start + shift
        if width:
            shift += width - len(lead)
        out.append((begin, line[-1][2] + shift, [(m, begin, begin) for m in marks] + [(k, x + shift, y + shift) for k, x, y in tokens]))
    return out


def python_tokens(text: str) -> list[Token] | None:
    lines = python_layout(text)
    return None if lines is None else [t for *_, tokens in lines for t in tokens]


_HASKELL = re.compile(
    rf"(?P<skip>--[^\r\n]*|\{{-(?!#)[\s\S]*?(?:-\}}|$(?![\s\S]))|[ \t]+|\n)|(?P<bracket>[()\[\],])|(?P<pragma>\{{-#[\s\S]*?#-\}})|(?P<string>{STRING})|(?P<char>'(?:[^'\\]|\\.)+')|(?P<brace>[{{}}])"
    r"|(?P<operator>[:!#$%&*+./<=>?@\\^|~-]+)|(?P<name>(?:[^\W\d]|_)+[\w']*)|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
)


def haskell_tokens(text: str) -> list[Token] | None:
    """Up to the first character that no rule takes; None if nothing is taken. Qualified names count as their last part."""
    out: list[Token] = []
    at = 0
    while m := _HASKELL.match(text, at):
        start, kind, at = at, m.lastgroup, m.end()
        if kind == "skip":
            continue
        if kind == "name":
            word = m[0]
            while word[0].isupper() and text[at : at + 1] == "." and (n := _HASKELL.match(text, at + 1)) and n.lastgroup == "name":
                word, at = n[0], n.end()
            kind = "type" if word[0].isupper() else word if word in HASKELL_WORDS else "identifier"
        elif kind == "operator":
            op = m[0]
            kind = ">>" if op in (">>", "*>") else op if op in HASKELL_OPERATORS else "constructor" if op[0] == ":" else "operator"
        elif kind in ("bracket", "brace"):
            kind = m[0]
        out.append((kind, start, at))
    return out if at else None


#: A loop word, the token behind it, and all up to the brace that ends the loop's head.
_LOOP_HEAD = re.compile(r"L.?[^{}]*[{}]?")
_FIRST_STATEMENT, _STATEMENT = re.compile(r".[^;{}]*;"), re.compile(r"[^;{}]*;")


def java_statements(text: str) -> list[tuple[int, int]]:
    """Character ranges of statements: between two of ; { }, ending at a ; once loop heads are gone.

    The tokens are written as one letter each, so that heads and statements are patterns of letters.
    The first token never ends a statement.
    """
    tokens = java_tokens(text)
    letters = "".join("L" if k == "loop" else k if k in (";", "{", "}") else "x" for k, *_ in tokens)
    heads = {i for m in _LOOP_HEAD.finditer(letters) for i in range(*m.span())}
    kept = [t for i, t in enumerate(tokens) if i not in heads]
    letters = "".join(c for i, c in enumerate(letters) if i not in heads)
    first = _FIRST_STATEMENT.match(letters)
    spans = [m.span() for m in ([first] if first else [])] + [m.span() for m in _STATEMENT.finditer(letters, first.end() if first else 1)]
    return [(kept[a][1], kept[b - 1][2]) for a, b in spans]


def python_statements(text: str) -> list[tuple[int, int]]:
    """Logical lines whose next line isn't indented deeper; a single line is one."""
    spans = [(a, b) for a, b, _ in python_layout(text) or []]
    if len(spans) < 2:
        return spans
    margin = [len(text[a:b]) - len(text[a:b].lstrip(" ")) for a, b in spans]
    return [s for s, own, following in zip(spans, margin, margin[1:], strict=False) if own >= following]


@dataclass(frozen=True)
class Language:
    """tokens: text to tokens or None; identifiers: kinds of names; opens, closes: block delimiters, or None
    where everything is one block; statements: text to ranges."""

    name: str
    extension: str
    tokens: Callable[[str], list[Token] | None]
    identifiers: frozenset[str] = frozenset({"identifier"})
    opens: str | None = None
    closes: str | None = None
    statements: Callable[[str], list[tuple[int, int]]] | None = None
    indented: bool = False


_WORDS = re.compile(r"[a-z0-9]+")
LANGUAGES = {
    "words": Language("words", ".txt", lambda t: [(m[0], m.start(), m.end()) for m in _WORDS.finditer(t.lower())]),
    "java": Language("java", ".java", java_tokens, opens="{", closes="}", statements=java_statements),
    "python": Language("python", ".py", python_tokens, opens="indent", closes="unindent", statements=python_statements, indented=True),
    "haskell": Language("haskell", ".hs", haskell_tokens, frozenset({"identifier", "type"})),
}


def register(language: Language) -> None:
    LANGUAGES[language.name] = language


def tokenize(text: Column, language: str) -> Column:
    """Array of (kind, start, end); null for null texts and where the tokenizer fails."""
    run = LANGUAGES[language].tokens

    @F.pandas_udf(TOKENS_TYPE)
    def tokens(texts: pd.Series) -> pd.Series:
        def one(t):
            got = None if t is None else run(t)
            return None if got is None else [{"kind": k, "start": a, "end": b} for k, a, b in got]

        return texts.map(one)

    return tokens(text)


def statement_ranges(text: Column, language: str) -> Column:
    """Array of (start, end) of the statements."""
    run = LANGUAGES[language].statements

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def ranges(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in run(t)])

    return ranges(text)


def identifiers(text: Column, tokens: Column, language: str) -> Column:
    """The texts under identifier tokens, each cut on its own."""
    kinds = sorted(LANGUAGES[language].identifiers)
    own = F.filter(tokens, lambda t: t["kind"].isin(kinds)) if language != "words" else tokens
    return F.transform(own, lambda t: F.substring(text, t["start"] + 1, t["end"] - t["start"]))


def without_spans(tokens: Column, first: str, last: str) -> Column:
    """Tokens outside of the spans from one of kind first to the next of kind last."""

    def step(acc: Column, t: Column) -> Column:
        drop = acc["drop"] | (t["kind"] == first)
        return F.struct((drop & (t["kind"] != last)).alias("drop"), F.when(drop, acc["out"]).otherwise(F.concat(acc["out"], F.array(t))).alias("out"))

    zero = F.struct(F.lit(False).alias("drop"), F.array().cast(TOKENS_TYPE).alias("out"))
    return F.aggregate(tokens, zero, step)["out"]
