"""Vectorised passes over the UTF-8 bytes of Arrow string columns.

A chunk is a run of whole documents; nothing here cuts a text. Words are maximal runs of bytes
other than space and 0x09-0x0D, with A-Z lower-cased, which equals the code-point definition
because UTF-8 continuation bytes are never ASCII.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}
CHUNK_BYTES = 1 << 20


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give this process's unused memory back."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Batches, *forget: Callable[[], None]) -> Batches:
    """run for mapInArrow, after which the worker gives its memory back: workers live on, and an executor has several."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            release()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse, modulo 2**64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _powers.clear() if size > 8 * CHUNK_BYTES else None
        _powers[inverse] = have
    return have[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span that depends on the content alone."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(n + 1, True)[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Chunk:
    """first: index of the first document; data: bytes of all; offsets: of each, with the end."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def starts_mask(self) -> np.ndarray:
        mask = np.zeros(len(self.data) + 1, bool)
        mask[self.offsets] = True
        return mask


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of an Arrow string array (null: empty), some at a time."""
    texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    if n == 0:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the index of each document's first."""
    if not len(chunk.data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(chunk) + 1, np.int64)
    inside = ~SPACE[chunk.data]
    cut = chunk.starts_mask()
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, chunk.offsets)


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the lower-cased words of a chunk."""
    starts, ends, first = words(chunk)
    return span_hashes(BYTE_VALUE[LOWER[chunk.data]], starts, ends), first


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of one document's runs of width words; of all words if fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix64(out ^ hashes[k : n - width + 1 + k]) + np.uint64(k + 1)
    out = np.sort(mix64(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
