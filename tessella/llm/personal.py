"""Personal data in whole texts: fixed patterns, and a semi-Markov conditional random field.

The patterns are email, ip, card and phone. The field reads the words around digits, at-signs and
their spelt forms, and adds secrets, social security numbers and account numbers (iban). Every run of up to MOST_WORDS words there is a candidate segment for every
kind, scored by features of the whole span (shape, digit counts, checksum, octets, affixes) and of
the words beside it; one recursion over segment ends chooses boundaries and kinds together. Its
weights are fitted to conditional likelihood on sentences made by rule, so no text is collected.
Found segments that touch no pattern's span are added.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import exp, inf, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import lean

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_SIGN = re.compile(r"[0-9@]+|[\[(][aA][tT][\])]|\b[dD][oO][tT]\b")
_WORD = re.compile(r"\S+")
MOST_WORDS = 5
BEFORE, AFTER = 3, 6
#: Log odds against "no entity" that a segment needs.
MARGIN = 2.0
#: Words that are held before what is settled is given.
FLUSH = 256


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches of EMAIL, sought from each at-sign."""
    end = at = 0
    while (at := text.find("@", max(at, end))) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            end = m.end()
        at += 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed patterns, sorted; a match that fails its check is dropped."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


_TRIM = "\"'“”‘’«»()[]{}<>,;:!?*#$%&|"
_RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^\W\d_]+")


@lru_cache(200_000)
def _shape(text: str) -> str:
    """Runs of letters and digits by kind, digit runs with their length up to 5; many runs by their number."""
    shape = _RUNS.sub(lambda m: f"9{min(len(m[0]), 5)}" if m[0][0].isdigit() else "A" if m[0].isupper() else "a", text)
    return shape if len(shape) <= 24 else f"runs{len(shape).bit_length()}"


def mod97(text: str) -> bool:
    """Whether letters and digits, the first four moved to the end, leave 1 modulo 97."""
    rest = 0
    for c in text[4:] + text[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _random_features(text: str) -> list[str]:
    """Of one word: how long and how mixed it is, and how often letters, capitals and digits change."""
    body = [c for c in text if c.isalnum() and c.isascii()]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in body]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    size = min(len(body), 48) // 8
    return [f"size{size}", f"mix{''.join(sorted(set(kinds)))}{size}", f"turns{min(turns, 24) // 3}", f"signs{min(len(text) - len(body), 4)}"]


def _span_features(words: list[str], i: int, j: int) -> list[str]:
    """Features of words[i:j] as one candidate."""
    text = " ".join(words[i:j]).strip(_TRIM).rstrip(".")
    digits = "".join(c for c in text if "0" <= c <= "9")
    n, signs = len(digits), "".join(sorted({c for c in text if not c.isalnum()}))
    low = text.lower()
    out = ["bias", f"n{j - i}", f"d{min(n, 20)}", f"shape:{_shape(text)}", f"signs:{signs}", f"first:{text[:1] if not text[:1].isalnum() else 'w' if text[:1].isalpha() else 'd'}"]
    if 13 <= n <= 19:
        out.append(f"luhn{luhn(digits)}")
    if text.count(".") == 3 and n == len(text) - 3:
        out.append(f"octets{all(p for p in text.split('.')) and octets(text)}")
    if j - i == 1 and len(text) >= 8:
        out += _random_features(text)
        if len(text) >= 16 and n >= 4 and all(c in "0123456789abcdefABCDEF" for c in text):
            out.append("hex")
    plain = text.replace(" ", "")
    if 15 <= len(plain) <= 34 and plain.isascii() and plain.isalnum() and plain[:2].isalpha() and plain[2:4].isdigit():
        out.append(f"mod97{mod97(plain)}")
    if re.search(r"\S+ ?(@|[\[(]at[\])]|\bat\b) ?\S+ ?(\.|[\[(]dot[\])]|\bdot\b) ?[a-z]{2,6}$", low):
        out.append("mailbox")
    if " dot " in low or "(dot)" in low or "[dot]" in low:
        out.append("spelt")
    out.append(f"letters{sum(c.isalpha() for c in text) > 0}")
    left = words[i - 1].lower().strip(_TRIM + ".") if i else "^"
    out.append(f"left:{left}" if left in _CUES else "left:-")
    out.append(f"left2:{words[i - 2].lower().strip(_TRIM + '.')}" if i > 1 and words[i - 2].lower().strip(_TRIM + ".") in _CUES else "left2:-")
    return out


_CUES = frozenset("token key secret password api_key = phone tel call fax mobile card visa number no email mail e-mail contact ssn iban account ip host address server from version license in on".split())


class SegmentField:
    """Weights by kind and feature; score(words, i, j, kind) is their sum."""

    def __init__(self, weights: dict[tuple[int, str], float]):
        self.weights = weights

    def _table(self, words: list[str]) -> list[list[tuple[int, list[str], list[float]]]]:
        """For each end j, the candidates (i, features, scores by kind)."""
        get = self.weights.get
        out, signed = [], [_SIGN.search(w) is not None for w in words]
        for j in range(1, len(words) + 1):
            row = []
            for i in range(max(0, j - MOST_WORDS), j):
                if not any(signed[i:j]):
                    continue
                f = _span_features(words, i, j)
                row.append((i, f, [sum(get((k, x), 0.0) for x in f) for k in range(len(KINDS))]))
            out.append(row)
        return out

    def entities(self, words: Iterable[str]) -> Iterator[tuple[int, int, int]]:
        """The highest-scoring segmentation's entities (i, j, kind); a word outside scores 0.

        Words are read one by one. What every segmentation that may still win has in common is given
        and forgotten, so a run of words of any length takes little memory.
        """
        get, held, signed = self.weights.get, [], []
        score, back, low, base = [0.0], [None], 0, 0  # of the states before, between and behind held; low is settled
        for word in words:
            held.append(word)
            signed.append(_SIGN.search(word) is not None)
            j = len(held)
            top, come = score[j - 1], (j - 1, None)
            last = next((x for x in range(j - 1, max(low, j - MOST_WORDS) - 1, -1) if signed[x]), -1)
            for i in range(max(low, j - MOST_WORDS), last + 1):
                f = _span_features(held, i, j)
                own = [sum([get((k, x), 0.0) for x in f]) for k in range(len(KINDS))]
                k = max(range(len(KINDS)), key=own.__getitem__)
                if own[k] > MARGIN and score[i] + own[k] > top:
                    top, come = score[i] + own[k], (i, k)
            score.append(top)
            back.append(come)
            if j >= FLUSH:
                open_ = set(range(max(low, j - MOST_WORDS + 1), j + 1))
                while len(open_) > 1:
                    x = max(open_)
                    open_ = open_ - {x} | {back[x][0] if x > low else low}
                cut = open_.pop()
                yield from self._traced(back, low, cut, base)
                keep = max(0, cut - 2)  # features look two words back
                held, signed, score, back, base, low = held[keep:], signed[keep:], score[keep:], [None if b is None else (b[0] - keep, b[1]) for b in back[keep:]], base + keep, cut - keep
        yield from self._traced(back, low, len(held), base)

    @staticmethod
    def _traced(back: list, low: int, j: int, base: int) -> list[tuple[int, int, int]]:
        out = []
        while j > low:
            i, k = back[j]
            if k is not None:
                out.append((base + i, base + j, k))
            j = i
        return out[::-1]

    def best(self, words: list[str]) -> list[tuple[int, int, int]]:
        return list(self.entities(words))

    def gradient(self, words: list[str], gold: set[tuple[int, int, int]]) -> dict[tuple[int, str], float]:
        """Of the log likelihood: features of the gold entities less their expectation."""
        table, n = self._table(words), len(words)
        up = lambda xs: (m := max(xs)) + log(sum(exp(x - m) for x in xs))
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = up([ahead[j - 1], *(ahead[i] + s for i, _, row in table[j - 1] for s in row)])
        starts = defaultdict(list)
        for j in range(1, n + 1):
            for i, _, row in table[j - 1]:
                starts[i].append((j, row))
        for i in range(n - 1, -1, -1):
            behind[i] = up([behind[i + 1], *(behind[j] + s for j, row in starts[i] for s in row)])
        out: dict[tuple[int, str], float] = defaultdict(float)
        for j in range(1, n + 1):
            for i, f, row in table[j - 1]:
                for k, s in enumerate(row):
                    d = ((i, j, k) in gold) - exp(ahead[i] + s + behind[j] - ahead[n])
                    if abs(d) > 1e-4:
                        for x in f:
                            out[k, x] += d
        return out


def _sentence(rng: random.Random) -> tuple[list[str], set[tuple[int, int, int]]]:
    """Words with at most two entities, or look-alikes that aren't any."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 9)))
    host = lambda: f"{w()}{rng.choice(['', d(1)])}"
    top = lambda: rng.choice(["com", "org", "net", "example.com", "de", "fr"])

    def card() -> str:
        body = rng.choice("3456") + d(14)
        digits = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return rng.choice([digits, " ".join(digits[k : k + 4] for k in range(0, 16, 4)), "-".join(digits[k : k + 4] for k in range(0, 16, 4)), "/".join(digits[k : k + 4] for k in range(0, 16, 4)), ".".join(digits[k : k + 4] for k in range(0, 16, 4))])

    def secret() -> str:
        small, mixed = "0123456789abcdef", "0123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
        some = lambda cs, n: "".join(rng.choice(cs) for _ in range(n))
        n = rng.choice([20, 24, 28, 32, 36, 40, 48, 64])
        body = rng.choice([lambda: some(small, n), lambda: some(mixed, n), lambda: some(mixed, n // 2) + rng.choice("-_/+") + some(mixed, n // 2), lambda: some("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", n), lambda: rng.choice("3579") + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n // 2) + rng.choice("3579") + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 6)])()
        lead = rng.choice(["", "", "", f"{w()[:2]}-", f"{w()[:3]}_", f"{w()[:4]}-{w()[:4]}-", some("ABCDEFGHIJKL", 4)])
        mark = rng.choice(["", "", '"', "'"])
        return mark + lead + body + mark

    def iban() -> str:
        country, body = rng.choice(["DE", "GB", "FR", "NL", "ES"]), "".join(rng.choice("0123456789") if rng.random() < 0.85 else rng.choice("ABCDEFGHKLMNRTW") for _ in range(rng.randint(12, 24)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        whole = f"{country}{check:02d}{body}"
        # At most as many groups as a segment has words.
        return whole if rng.random() < 0.6 or len(whole) > 20 else " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))

    makers = {
        0: lambda: rng.choice([f"{w()}.{d(2)}@{host()}.{top()}", f"{w()} at {host()} dot com", f"{w()} (at) {host()} (dot) org", f"{w()}[at]{host()}[dot]net", f"{w()} [at] {host()} [dot] com", f"{w()} @ {host()} . com"]),
        1: lambda: rng.choice([".", ".", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4)),
        2: card,
        3: lambda: rng.choice([f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(6)}", ".".join([d(3), d(3), d(4)])]),
        4: secret,
        5: lambda: rng.choice(["-", "-", " "]).join([str(rng.randint(100, 899)), d(2), d(4)]),
        6: iban,
    }
    cue = {0: ["email", "contact"], 1: ["ip", "host", "server"], 2: ["card", "visa"], 3: ["phone", "tel", "call", "call me at"], 4: ["token =", "key =", "secret =", "password =", "token:", "key:", "password:"], 5: ["ssn", "number"], 6: ["iban", "account"]}
    decoys = [lambda: f"{d(1)}.{d(1)}", lambda: f"version {d(1)}", lambda: d(rng.randint(1, 9)), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"${d(3)}.{d(2)}", lambda: f"{w()}{d(2)}", lambda: f"{d(3)}-{d(3)}", lambda: f"dot {w()}", lambda: f"{d(2)}:{d(2)}", lambda: f"{w()} at {w()} {d(2)}", lambda: f"@{w()}", lambda: f"{d(2)},{d(3)},{d(3)}", lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"1{d(15)}", lambda: f"{w()}-{w()}-{d(2)}", lambda: f"{w()}_{w()}{d(1)}.py", lambda: f"http://{w()}.com/{w()}/{d(5)}", lambda: f"{w().upper()}-{d(4)}", lambda: f"{d(4)}/{d(2)}", lambda: f"{w()}{d(4)}{w()}", lambda: f"{d(2)} {w()} {d(4)}", lambda: f"{d(1)} {d(2)} {d(3)}", lambda: f"{w()}.{w()}({d(2)})"]
    words: list[str] = []
    gold = set()
    for _ in range(rng.randint(1, 3)):
        words += [w() + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.55:
            k = rng.randrange(len(KINDS))
            if rng.random() < (0.8 if k in (4, 5) else 0.5):
                words += rng.choice(cue[k]).split()
            piece = makers[k]().split(" ")
            gold.add((len(words), len(words) + len(piece), k))
            words += [*piece[:-1], piece[-1] + rng.choice(["", "", ".", ","])]
        else:
            words += rng.choice(decoys)().split(" ")
    return words + [w() for _ in range(rng.randint(0, 3))], gold


@lru_cache(4)
def fit_field(sentences: int = 2500, epochs: int = 3, seed: int = 11, rate: float = 0.4, decay: float = 1e-3) -> SegmentField:
    """Stochastic ascent of the conditional likelihood over made sentences; the same weights each time."""
    rng = random.Random(seed)
    data = [_sentence(rng) for _ in range(sentences)]
    field = SegmentField({(k, "bias"): -3.0 for k in range(len(KINDS))})
    for epoch in range(epochs):
        rng.shuffle(data)
        step = rate / (1 + epoch)
        for words, gold in data:
            for key, g in field.gradient(words, gold).items():
                field.weights[key] = field.weights.get(key, 0.0) * (1 - decay * step) + step * g
    return field


def _near_signs(text: str) -> Iterator[Iterator[tuple[int, int]]]:
    """Runs of word spans, each read while it is used: from BEFORE words ahead of a sign to AFTER words behind the last one."""
    sign, end = _SIGN.search(text), 0

    def run(low: int) -> Iterator[tuple[int, int]]:
        nonlocal sign, end
        left, end = AFTER, low
        ahead = True  # of the run's first sign
        while (ahead or left) and (m := _WORD.search(text, end)):
            end = m.end()
            if sign and sign.start() < end:
                ahead, left = False, AFTER
                while sign and sign.start() < end:
                    sign = _SIGN.search(text, sign.end())
            elif not ahead:
                left -= 1
            yield m.span()

    while sign:
        low = sign.start()
        for k in range(BEFORE + 1):
            while low > end and not text[low - 1].isspace():
                low -= 1
            while k < BEFORE and low > end and text[low - 1].isspace():
                low -= 1
        words = run(low)
        yield words
        for _ in words:  # what the caller left
            pass


def field_spans(text: str, field: SegmentField) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the field's entities, without the marks around them."""
    out = set()
    for spans in _near_signs(text):
        seen: deque[tuple[int, int]] = deque()
        first = 0

        def words(spans: Iterator[tuple[int, int]] = spans, seen: deque = seen) -> Iterator[str]:
            for a, b in spans:
                seen.append((a, b))
                yield text[a:b]

        for i, j, k in field.entities(words()):
            while first < i:
                seen.popleft()
                first += 1
            a, b = seen[0][0], seen[j - 1 - first][1]
            while a < b and text[a] in (_TRIM if text[a] != "(" or k != 3 else ""):
                a += 1
            while b > a and text[b - 1] in _TRIM + ".":
                b -= 1
            # A card's number must pass its checksum here as well.
            if b > a and (k != 2 or luhn("".join(c for c in text[a:b] if c in "0123456789"))):
                out.add((a, k, b))
    return sorted(out)


def personal_spans(text: str | None, field: SegmentField) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) sorted by start and kind: all base spans, and the field's that touch none of them or each other."""
    if not text:
        return []
    base = base_spans(text)
    out, end = [(a, k, b, True) for a, k, b in base], 0
    for a, k, b in field_spans(text, field):
        if a >= end and not any(a < y and x < b for x, _, y in base):
            out.append((a, k, b, False))
            end = b
    return sorted(out)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SegmentField | None = None) -> DataFrame:
    """(id, spans) for every row; spans: array of (kind, start, end, base) in code points, end exclusive.

    Null and empty texts have no spans; repeated rows and null ids pass through.
    """
    field = field or fit_field()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": s} for a, k, b, s in personal_spans(t.as_py(), field)] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=["id", "spans"])

    return rows.mapInArrow(lean(run, _shape.cache_clear), f"id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def op2_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, the number of all spans, and all spans as text.

    Null and empty texts have none; repeated rows each give a row.
    """
    got = find_personal_data(docs)
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS[:4]], F.size("spans").cast("long").alias("n_spans"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
