"""Packing documents into token sequences in the order of a space-filling curve.

A document's hashed word counts are projected to a few dimensions by random signs; the cell it
falls into has a key along a Hilbert curve. Documents are dealt by ranges of that key, sorted, and
cut end to end into sequences, so that a sequence holds documents with much vocabulary in common.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import chunks, lean, mix64, word_hashes
from .tokenize import encoder, forget
from .work import bucket_of, materialize, range_edges

DIMENSIONS = 4
BITS = 9
TIE_BITS = 26
END = 1


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points (one a row) with coordinates below 2**bits.

    Coordinates become the curve's transposed index by undoing, from the highest bit down, the
    exchanges and inversions of each level, and Gray-decoding what is left.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            flip = (x[d] & q) != 0
            swap = (x[0] ^ x[d]) & low
            first = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[d] = np.where(flip, x[d], x[d] ^ swap) if d else first
            x[0] = first
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> b & 1)
    return key


def cells_of(hashes: np.ndarray, first: np.ndarray, dims: int, bits: int) -> np.ndarray:
    """Grid cells of documents: sums of word signs over the root of the word count, through the normal distribution's shape."""
    n = len(first) - 1
    count = np.maximum(np.diff(first), 1)
    out = np.zeros((n, dims), np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    for d in range(dims):
        sign = 1.0 - 2.0 * ((hashes >> np.uint64(d)) & np.uint64(1)).astype(np.float64)
        z = np.bincount(doc, sign, n) / np.sqrt(count)
        # Frequent words carry a sum far beyond that of independent signs.
        share = 1 / (1 + np.exp(-z / 2))
        out[:, d] = np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)
    return out


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = encoder()
    for batch in batches:
        for c in chunks(batch.column(1)):
            hashes, first = word_hashes(c)
            key = hilbert_key(cells_of(hashes, first, DIMENSIONS, BITS), BITS)
            own = batch.column(0).slice(c.first, len(c))
            tie = mix64(own.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - TIE_BITS)
            ids, cut = enc.encode(c)
            n = np.diff(cut) + 1
            full = np.full(len(ids) + len(c), END, "<u2")
            full[np.arange(len(ids)) + np.repeat(np.arange(len(c)), np.diff(cut))] = ids
            offsets = np.zeros(len(c) + 1, np.int32)
            np.cumsum(2 * n, out=offsets[1:])
            tokens = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(offsets), pa.py_buffer(full)])
            yield pa.RecordBatch.from_arrays([own, pa.array(key << TIE_BITS | tie.astype(np.int64)), pa.array(n), tokens], names=["id", "key", "n", "ids"])


def _packed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, used, sequence = None, 0, 0
        tail: list[tuple] = []  # pieces of the sequence being filled
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def close(tail: list[tuple], used: int, sequence: int) -> list[tuple]:
            """The last sequence of a bucket, cut into sequences of powers of two, which need no padding."""
            out, done, k = [], 0, sequence
            cuts = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
            pieces = list(tail)
            for size in cuts:
                at = 0
                while at < size:
                    doc, start, ids, total = pieces.pop(0)
                    take = min(len(ids), size - at)
                    out.append((doc, start, ids[:take], total, k, at))
                    if take < len(ids):
                        pieces.insert(0, (doc, start + take, ids[take:], total))
                    at += take
                k += 1
            return out

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            crc = [zlib.crc32(p[2].astype("<u4").tobytes()) for p in pieces]
            cols = [[p[0] for p in pieces], [p[1] for p in pieces], [len(p[2]) for p in pieces], crc, [p[3] for p in pieces], [p[4] for p in pieces], [p[5] for p in pieces]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            done: list[tuple] = []
            for b, doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != bucket:
                    done += close(tail, used, sequence)
                    bucket, used, sequence, tail = b, 0, b << 32, []
                ids = np.frombuffer(raw.as_buffer(), "<u2")
                at = 0
                while at < len(ids):
                    take = min(length - used, len(ids) - at)
                    tail.append((doc, at, ids[at : at + take], len(ids)))
                    used, at = used + take, at + take
                    if used == length:
                        where = 0
                        for p in tail:
                            done.append((*p, sequence, where))
                            where += len(p[2])
                        used, sequence, tail = 0, sequence + 1, []
            tail = [(p[0], p[1], p[2].copy(), p[3]) for p in tail]
            if done:
                yield batch_of(done)
        if tail:
            yield batch_of(close(tail, used, sequence))

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 2048, tokens_a_bucket: int = 2_000_000) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece.

    Each document's ids and END stand in exactly one piece each, in order. Sequences are full but
    for the last of each range of keys, which is cut into sequences of powers of two; so nothing
    is padded. Null and empty texts are the END token alone; rows with a null id are packed too,
    and repeated rows each have their pieces. Ties of the key are dealt by a hash of the id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = materialize(rows.mapInArrow(lean(_encoded, forget), "id long, key long, n long, ids binary"), "ids")
    total = made.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // tokens_a_bucket))
    bucket = bucket_of(F.col("key"), range_edges(made, "key", buckets))
    dealt = made.select(bucket.alias("bucket"), "id", "ids", "key").repartition(buckets, "bucket").sortWithinPartitions("bucket", "key", "id")
    return dealt.select("bucket", "id", "ids").mapInArrow(lean(_packed(length)), "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_pack(docs: DataFrame) -> DataFrame:
    """Pieces of all documents, none padded; null texts and repeated rows as in pack_documents."""
    return pack_documents(docs).withColumnRenamed("id", "doc_id")
