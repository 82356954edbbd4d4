"""Audio fingerprints from pitch classes, and alignment of recordings.

Short spectra are folded into 12 pitch classes, smoothed and scaled. Filters that compare sums of
rectangles of that image, taken from its integral image, give two bits each: one packed integer
of 32 bits a frame. Equal integers of two recordings vote for an offset between them; the share of
differing bits at the offsets with most votes tells whether they hold the same sound.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialize

RATE = 4000
FRAME = 1024
HOP = 341
LOWEST, HIGHEST = 80.0, 1800.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: 16 filters: (kind, first class, classes, frames), from sizes that repeat with different periods.
FILTERS = [(k % 4, (5 * k) % (13 - h), h, w) for k, h, w in zip(range(16), [12, 4, 6, 3, 8, 5, 10] * 3, [4, 8, 6, 12, 10] * 4, strict=False)]
WIDEST = max(f[3] for f in FILTERS)
#: Log ratios between which the middle two of a filter's four codes lie.
STEP = 0.4
GRAY = np.array([0, 1, 3, 2], np.uint32)


def samples(data: bytes | None) -> np.ndarray:
    """Mono samples at RATE of a 16-bit PCM WAV file; nothing for null or unreadable bytes."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0, np.float32)
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768.0
            if w.getframerate() != RATE and len(x):
                x = np.interp(np.arange(0, len(x), w.getframerate() / RATE), np.arange(len(x)), x)
            return x.astype(np.float32)
    except (wave.Error, EOFError, ValueError, ZeroDivisionError):
        return np.zeros(0, np.float32)


def chroma(x: np.ndarray) -> np.ndarray:
    """One row of 12 pitch-class shares for each frame; silent frames are all zero."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    n = 1 + (len(x) - FRAME) // HOP
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n] * np.hamming(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (hz >= LOWEST) & (hz <= HIGHEST)
    kind = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    out = power[:, use] @ np.eye(12)[kind]
    if n >= len(SMOOTH):
        out = sum(w * out[k : n - len(SMOOTH) + 1 + k] for k, w in enumerate(SMOOTH))
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0.0)


def fingerprint(data: bytes | None) -> np.ndarray:
    """Packed integers, one for each position where the widest filter fits."""
    image = chroma(samples(data))
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)
    area = lambda t0, t1, c0, c1: total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]
    out = np.zeros(n, np.uint32)
    for kind, c, h, w in FILTERS:
        whole = area(0, w, c, c + h)
        if kind == 0:  # earlier against later frames
            a = area(0, w // 2, c, c + h)
        elif kind == 1:  # lower against higher classes
            a = area(0, w, c, c + h // 2)
        elif kind == 2:  # opposite quarters
            a = area(0, w // 2, c, c + h // 2) + area(w // 2, w, c + h // 2, c + h)
        else:  # middle frames against both sides
            a = area(w // 3, w - w // 3, c, c + h)
        value = np.log1p(a) - np.log1p(whole - a)
        out = out << np.uint32(2) | GRAY[np.digitize(value, [-STEP, 0.0, STEP])]
    return out.view(np.int32)


def audio_fingerprints(media: DataFrame, id_col: str, audio_col: str = "audio") -> DataFrame:
    """(id, frames) for every row: array of packed integers, empty if null, unreadable or too short."""
    rows = media.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(x.as_py()) for x in part.column(1)], pa.list_(pa.int32()))], names=["id", "frames"])

    return rows.mapInArrow(run, f"id {media.schema[id_col].dataType.simpleString()}, frames array<int>")


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of one value."""
    at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return at, np.diff(np.r_[at, len(a)])


def offset_votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each offset from 1 - len(a) to len(b) - 1, how many frames of a equal the one of b that far on.

    Two runs of one value add a trapezoid, which four points of its second difference make.
    """
    (at, size), (bt, bsize) = _runs(a), _runs(b)
    order = np.argsort(b[bt], kind="stable")
    values = b[bt][order]
    low, high = np.searchsorted(values, a[at], "left"), np.searchsorted(values, a[at], "right")
    n = high - low
    i = np.repeat(np.arange(len(at)), n)
    j = order[np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(low, n)]
    first = bt[j] - at[i] - size[i] + len(a)  # the offset of one shared frame, from 1 - len(a)
    bend = np.zeros(len(a) + len(b) + 1, np.int64)
    for where, by in ((first, 1), (first + size[i], -1), (first + bsize[j], -1), (first + size[i] + bsize[j], 1)):
        bend += by * np.bincount(where, minlength=len(bend))
    return bend.cumsum().cumsum()[: len(a) + len(b) - 1]


def best_offset(a: np.ndarray, b: np.ndarray, most_error: float, least_overlap: int) -> tuple[int, float] | None:
    """(offset, bit error) with most votes of those that overlap and agree enough (ties: least error, then smallest)."""
    votes = offset_votes(a, b)
    offset = np.arange(len(votes)) + 1 - len(a)
    start = np.maximum(0, -offset)
    length = np.minimum(len(a) - start, len(b) - start - offset)
    use = np.flatnonzero((votes > 0) & (length >= least_overlap))
    best = None
    for k in use[np.argsort(-votes[use], kind="stable")].tolist():
        if best and votes[k] < -best[0]:
            break
        s, n, o = int(start[k]), int(length[k]), int(offset[k])
        error = int(np.bitwise_count((a[s : s + n] ^ b[s + o : s + o + n]).view(np.uint32)).sum()) / (32 * n)
        if error <= most_error:
            best = min(best or (1,), (-int(votes[k]), error, abs(o), o))
    return best and (best[3], best[1])


def align(prints: DataFrame, is_query, *, most_error: float = 0.30, least_overlap: int = 16) -> DataFrame:
    """(q, r, offset, bit_error): classes of recordings that match a query's, from (id, frames).

    Recordings with equal fingerprints are one class, named by its least id: q and r. Each pair of
    equal integers votes for an offset; of all offsets with a vote and enough shared frames, a pair
    takes the one with most votes whose error is small enough (ties: the least error, then the
    smallest offset).
    """
    classes = materialize(prints.where(F.size("frames") > 0).groupBy("frames").agg(F.min("id").alias("r"), F.max(is_query).alias("asks")), "audio")
    values = lambda rows, name: rows.select(F.col("r").alias(name), F.explode(F.array_distinct("frames")).alias("v"))
    pairs = values(classes.where("asks"), "q").join(values(classes, "r"), "v").select("q", "r").distinct()
    both = pairs.join(classes.select(F.col("r").alias("q"), F.col("frames").alias("fq")), "q").join(classes.select("r", F.col("frames").alias("fr")), "r").select("q", "r", "fq", "fr")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_offset(*(batch.column(c)[k].values.to_numpy() for c in (2, 3)), most_error, least_overlap) for k in range(batch.num_rows)]
            at = pa.array([k for k, x in enumerate(found) if x], pa.int64())
            found = [x for x in found if x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.float64())], names=["q", "r", "offset", "bit_error"])

    kind = classes.schema["r"].dataType.simpleString()
    return both.mapInArrow(judge, f"q {kind}, r {kind}, offset int, bit_error double")


NOTE = 512


def tone_recordings(embeddings: DataFrame) -> DataFrame:
    """(vec_id, audio): each vector played as one note for each number, in a WAV file.

    There is no table of recordings; this makes one by rule. Numbers from -0.35 to 0.35 become
    three octaves from 110 Hz; null vectors become null, null numbers rests.
    """
    rows = embeddings.select("vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(NOTE) / RATE
        shape = np.minimum(1, np.minimum(np.arange(NOTE), np.arange(NOTE)[::-1]) / 40)
        scale = np.stack([0.4 * shape * (np.sin(2 * np.pi * f * t) + 0.3 * np.sin(4 * np.pi * f * t)) for f in 110.0 * 2 ** (np.arange(37) / 12)] + [np.zeros(NOTE)])
        scale = (scale * 32767).astype("<i2")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                for v in part.column(1):
                    if not v.is_valid:
                        out.append(None)
                        continue
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    note = np.where(np.isnan(x), 37, np.clip(np.round((np.nan_to_num(x) + 0.35) / 0.7 * 36), 0, 36)).astype(int)
                    held = io.BytesIO()
                    with wave.open(held, "wb") as w:
                        w.setparams((1, 2, RATE, 0, "NONE", ""))
                        w.writeframes(scale[note].tobytes())
                    out.append(held.getvalue())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["vec_id", "audio"])

    return rows.mapInArrow(run, "vec_id long, audio binary")


def op10_chroma(embeddings: DataFrame) -> DataFrame:
    """One row for each recording: its fingerprint, and how it aligns with the queries, ids divisible by 100.

    class_id is the least id with the same fingerprint; n_links counts the query classes that match,
    its own included if it asks; best_query, best_offset and best_error are those of the least bit
    error (ties: the smaller id), null without a match.
    """
    prints = materialize(audio_fingerprints(tone_recordings(embeddings), "vec_id"), "prints")
    links = align(prints, F.coalesce(F.col("id") % 100 == 0, F.lit(False)))
    best = materialize(links.groupBy("r").agg(F.count("*").alias("n_links"), F.min(F.struct("bit_error", "q", "offset")).alias("m")), "links")
    classes = prints.where(F.size("frames") > 0).groupBy("frames").agg(F.min("id").alias("class_id"))
    rows = prints.join(classes, "frames", "left").join(best, F.col("class_id") == F.col("r"), "left")
    text = F.array_join(F.transform("frames", lambda v: F.lpad(F.lower(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")
    return rows.select(F.col("id").alias("vec_id"), F.size("frames").cast("long").alias("n_frames"), text.alias("fingerprint"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("m.q").alias("best_query"), F.col("m.offset").cast("long").alias("best_offset"), F.col("m.bit_error").alias("best_error"))
