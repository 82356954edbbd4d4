"""Document fingerprints from content-defined chunks.

A gear hash over the last WINDOW bytes marks cut points; a stricter mark is asked for before the
normal chunk size and a looser one after it. A fingerprint is the multiset of chunk digests with
the bytes each covers, so an insertion changes the chunks it touches and no others. Likeness is
the share of a text's bytes in chunks that the other has as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textvec import BYTE_VALUE, Chunk, chunks, lean, span_hashes
from .work import bucket_of, materialize, range_edges

WINDOW = 16
LEAST, NORMAL, MOST = 16, 48, 256
STRICT_BITS, LOOSE_BITS = 7, 5
GEAR = (BYTE_VALUE >> np.uint64(32)).astype(np.uint32)
ROWS_A_BUCKET, MOST_BUCKETS = 4000, 8192


def cut_points(chunk: Chunk) -> tuple[list[int], list[int]]:
    """(ends of all chunks, number of chunks of each document)."""
    h = GEAR[chunk.data]
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = (h[loose] >> np.uint32(32 - STRICT_BITS) == 0).tolist()
    first = np.searchsorted(loose, chunk.offsets).tolist()
    loose = (loose + 1).tolist()
    ends: list[int] = []
    counts = []
    offsets = chunk.offsets.tolist()
    for d in range(len(chunk)):
        start, stop, k, top = offsets[d], offsets[d + 1], first[d], first[d + 1]
        had = len(ends)
        while start < stop:
            low, mid, high = start + LEAST, start + NORMAL, min(start + MOST, stop)
            while k < top and (loose[k] < low or loose[k] < mid and not strict[k]):
                k += 1
            start = loose[k] if k < top and loose[k] < high else high
            ends.append(start)
        counts.append(len(ends) - had)
    return ends, counts


def fingerprints(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct digests of 48 bits, bytes under each) for each text."""
    for c in chunks(texts):
        ends, counts = cut_points(c)
        ends = np.array(ends, np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        digests = span_hashes(BYTE_VALUE[c.data], starts, ends) >> np.uint64(16)
        sizes, at = ends - starts, 0
        for n in counts:
            order = np.argsort(digests[at : at + n], kind="stable")
            d, s = digests[at : at + n][order], sizes[at : at + n][order]
            head = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if n else np.zeros(0, np.int64)
            yield d[head], np.add.reduceat(s, head) if n else s
            at += n


def to_text(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    """20 hexadecimal digits for each digest: 12 of it, 8 of its bytes."""
    d, s = fingerprint
    out = np.empty((len(d), 10), np.uint8)
    out[:, :6] = d.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    out[:, 6:] = s.astype(">u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes().hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of a's bytes in chunks that b has too; two empty texts are alike, one is like nothing."""
    if not len(a[0]):
        return float(not len(b[0]))
    if not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    return float(np.minimum(a[1][hit], b[1][at[hit]]).sum() / a[1].sum())


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every row; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(f) for f in fingerprints(batch.column(1))], pa.string())], names=["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, guest, id, text), dealt by ranges of the id and sorted downwards within each bucket.

    The last row of each bucket is a guest: the first row of the next one, so that every row's
    next row follows it. Ids equal or null are ordered by a hash of their text; null ids come last.
    """
    key = F.coalesce("id", F.lit(-(1 << 63)))
    keyed = docs.select("id", "text", key.alias("key"), F.xxhash64("text").alias("h"))
    narrow = materialize(keyed.select("key", "h"), "keys")
    buckets = max(1, min(MOST_BUCKETS, -(-narrow.count() // ROWS_A_BUCKET)))
    edges = range_edges(narrow, "key", buckets)
    heads = narrow.select(bucket_of(F.col("key"), edges).alias("bucket"), "key", "h").groupBy("bucket").agg(F.max(F.struct("key", "h")).alias("m"))
    # One row a bucket, at most MOST_BUCKETS: small enough for one task and for a broadcast.
    everyone = Window.orderBy("bucket")
    heads = heads.select(F.coalesce(F.lead("bucket").over(everyone), F.min("bucket").over(Window.partitionBy())).alias("bucket"), F.col("m.key").alias("key"), F.col("m.h").alias("h"))
    guests = keyed.join(F.broadcast(heads), ["key", "h"]).groupBy("bucket").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.first("key").alias("key"), F.first("h").alias("h"))
    own = keyed.select(bucket_of(F.col("key"), edges).alias("bucket"), F.lit(0).alias("guest"), "id", "text", "key", "h")
    both = own.unionByName(guests.select("bucket", F.lit(1).alias("guest"), "id", "text", "key", "h"))
    return both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), F.desc("h")).select("bucket", "guest", "id", "text")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[int | None, str] | None = None  # the row whose next one hasn't come yet
    held_print = None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column(3).fill_null("")
            guests, ids, bodies = part.column(1).to_pylist(), part.column(2).to_pylist(), texts.to_pylist()
            prints = list(fingerprints(texts))
            done = []
            for k, body in enumerate(bodies):
                if held is not None:
                    half = len(held[1]) // 2
                    done.append((*held, held[1][: len(held[1]) - half] + body[:half], held_print, prints[k]))
                held, held_print = (None, None) if guests[k] else ((ids[k], body), prints[k])
            if not done:
                continue
            edited = list(fingerprints(pa.array([d[2] for d in done], pa.string())))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d[0] for d in done], pa.int64()),
                    pa.array([len(d[1]) for d in done], pa.int64()),
                    pa.array([hashlib.sha256(d[2].encode()).hexdigest() for d in done], pa.string()),
                    pa.array([to_text(d[3]) for d in done], pa.string()),
                    pa.array([to_text(e) for e in edited], pa.string()),
                    pa.array([likeness(d[3], e) for d, e in zip(done, edited, strict=True)], pa.float64()),
                    pa.array([likeness(d[3], d[4]) for d in done], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def op5_fingerprint(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row for each document; null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_next(rows).mapInArrow(lean(_compared), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
