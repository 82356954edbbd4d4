"""Token ids of many texts at once.

Texts are pre-tokenized in vectorised passes; each distinct pre-token of a worker is encoded once
by byte-pair merges over the ranks of the same vocabulary, and ids are gathered for all places.
Texts with code points outside the ranges whose Unicode classes are settled go through the
`tokenizers` library itself. Tests hold the ids against that library.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import regex

from .textvec import BYTE_VALUE, Chunk, span_hashes

VOCABULARY = "byte_bpe_50k"
LETTER, NUMBER, SPACE = 1, 2, 3
SETTLED = ((0, 0x0530), (0x1E00, 0x2C00), (0x3000, 0x3100), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
#: Distinct pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 500_000
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point; 4: unsettled."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, 4, np.uint8)
        for low, high in SETTLED:
            table[low:high] = 0
            span = "".join(map(chr, range(low, high)))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
                for m in regex.finditer(pattern, span):
                    table[low + m.start() : low + m.end()] = kind
        _classes = table
    return _classes


def pre_tokens(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, unsettled) for code points of documents that start at first (with the end)."""
    kind = classes()[code]
    n = len(code)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    head = begins[:n].copy()
    start = head.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # A blank run before something else: its last character stands alone, or leads what follows if it is a space.
    after = np.flatnonzero(start[1:] & ~head[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[code[after - 1] == 0x20]] = False
    # 's 't 'm 'd 're 've 'll: an apostrophe that starts a pre-token and has no other sign after it.
    mark = np.flatnonzero((code == 0x27) & start)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~head[mark + 1]]
    if len(mark):
        one = code[mark + 1]
        last = np.minimum(mark + 2, n - 1)
        two = np.where((mark + 2 < n) & ~begins[mark + 2], code[last], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, width in ((short, 2), (long & ~short, 3)):
            at = mark[hit]
            start[at + 1] = False
            at = at[at + width < n] + width
            start[at] = True
    unsettled = np.add.reduceat(np.concatenate([kind == 4, [False]]), np.minimum(first[:-1], n)) * (np.diff(first) > 0)
    return np.flatnonzero(start), unsettled > 0


@dataclass
class Encoder:
    """Remembers the ids of distinct pre-tokens: hash -> ids in one flat array."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint16))

    def __post_init__(self):
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{VOCABULARY}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.piece = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{VOCABULARY}.json"))
        self.whole.encode_special_tokens = True

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        got = [self.piece(p) for p in pieces]
        if len(self.known) + len(got) > REMEMBERED:
            self.known, self.row, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint16)
        row = np.arange(len(self.at) - 1, len(self.at) - 1 + len(got))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(g) for g in got])])
        self.ids = np.concatenate([self.ids, np.fromiter((i for g in got for i in g), np.uint16)])
        place = np.searchsorted(self.known, hashes)
        self.known, self.row = np.insert(self.known, place, hashes), np.insert(self.row, place, row)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of a chunk's documents; every document is encoded whole."""
        raw = chunk.data.tobytes()
        lead = (chunk.data & 0xC0) != 0x80
        byte_of = np.append(np.flatnonzero(lead), len(chunk.data))
        first = np.searchsorted(byte_of, chunk.offsets)
        code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        if not len(code):
            return np.zeros(0, np.uint16), np.zeros(len(chunk) + 1, np.int64)
        starts, unsettled = pre_tokens(code, first)
        begin = byte_of[starts]
        end = np.append(begin[1:], len(chunk.data))
        hashes, back, inverse = np.unique(span_hashes(BYTE_VALUE[chunk.data], begin, end), return_index=True, return_inverse=True)
        for again in (True, False):
            place = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
            missing = self.known[place] != hashes if len(self.known) else np.ones(len(hashes), bool)
            if not missing.any():
                break
            assert again
            if len(self.known) + missing.sum() > REMEMBERED:
                missing[:] = True
            self._learn(hashes[missing], [raw[b:e] for b, e in zip(begin[back[missing]].tolist(), end[back[missing]].tolist(), strict=True)])
        row = self.row[place][inverse]
        source, size = self.at[row], self.at[row + 1] - self.at[row]
        total = np.zeros(len(row) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.ids[np.repeat(source - total[:-1], size) + np.arange(total[-1])]
        cut = total[np.searchsorted(starts, first)]
        if unsettled.any():
            parts = [ids[cut[k] : cut[k + 1]] for k in range(len(chunk))]
            odd = np.flatnonzero(unsettled)
            for k, e in zip(odd, self.whole.encode_batch([raw[chunk.offsets[k] : chunk.offsets[k + 1]].decode("utf-8") for k in odd], add_special_tokens=False), strict=True):
                parts[k] = np.array(e.ids, np.uint16)
            ids, cut = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, cut


_encoder: Encoder | None = None


def encoder() -> Encoder:
    """The worker's own."""
    global _encoder
    _encoder = _encoder or Encoder()
    return _encoder


def forget() -> None:
    global _encoder
    _encoder = None
