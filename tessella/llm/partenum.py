"""Jaccard self-join of word n-gram sets by PartEnum signatures.

Sets fall into bands by size. Sets A and B with similarity s or more differ in at most
k = (1 - s) / (1 + s) * (|A| + |B|) elements. The domain is partitioned by hash into n1 groups of
n2 partitions; when k differences meet n1 groups, enough groups have at most k2 of them, and there
n2 - k2 partitions agree. So similar sets share a signature: the content of one subset of a
group's partitions. A set also takes part in the next band if a partner may stand there.

Documents with one set are one class. A signature's classes first meet its least one, then the
least of the rest; pairs pass an exact bound on parity bits, then an exact count of common
shingles. Classes of a signature that stay in different components are compared by their bits
alone, in blocks; a forest of likely links leaves a block to be counted, and where one of them
fails, all that the bits let pass. So no link is lost, while a group of near copies costs rows in
proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from itertools import combinations
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .textvec import chunks, lean, mix64, shingles, word_hashes
from .work import collect_garbage, discard, materialize, with_least

PARTITIONS = 2  # n2
DIFFERING = 1  # k2
SUBSETS = list(combinations(range(PARTITIONS), PARTITIONS - DIFFERING))
#: A band ends at this many times its start.
BAND = Fraction(3, 2)
#: A signature over fewer elements than this is left out where the spare groups allow.
LEAST_ELEMENTS = 3
SPARE = 0.12
#: Classes of a signature that one task compares with as many others, by their parity bits.
BLOCK = 1024
#: Pairs of a block that leave a worker at once.
PART = 1 << 16
#: Parity slots for each difference that a pair may have.
SLOTS = 5


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    k: int
    groups: int


@lru_cache(4096)
def band(index: int, similarity: Fraction) -> Band:
    low = 1 if index == 0 else band(index - 1, similarity).high + 1
    high = max(low, floor(low * BAND))
    k = floor((1 - similarity) / (1 + similarity) * 2 * high)
    # At least groups - k / (k2 + 1) groups have at most k2 differences each.
    need = k // (DIFFERING + 1) + 1
    return Band(low, high, k, need + int(need * SPARE))


@lru_cache(65536)
def bands_of(n: int, similarity: Fraction) -> tuple[int, ...]:
    """The band of n elements, and those above it up to the largest partner's."""
    i = _index(n, similarity)
    j = _index(floor(n / similarity), similarity)
    return tuple(range(i, j + 1))


@lru_cache(65536)
def _index(n: int, similarity: Fraction) -> int:
    i = 0
    while band(i, similarity).high < n:
        i += 1
    return i


def signatures(elements: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set, with the band in the low byte, and how many more of the band may be left out.

    A set's partners of a band differ from it in at most as many elements as the largest of them
    may, so they agree with it in more than `spare` groups. Hence each set may go without its last
    `spare` signatures, in any order that depends on signatures alone: here those over the fewest
    elements, if fewer than LEAST_ELEMENTS. Bands without room for a difference give none: equal
    sets are one class already.
    """
    n = len(elements)
    out, rest = [np.zeros(0, np.uint64)], [np.zeros(0, np.int16)]
    for i in bands_of(n, similarity):
        b = band(i, similarity)
        if b.k == 0:
            continue
        k = floor((1 - similarity) / (1 + similarity) * (n + min(b.high, floor(n / similarity))))
        spare = b.groups - k // (DIFFERING + 1) - 1
        slots = b.groups * PARTITIONS
        at = ((elements >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        edges = np.searchsorted(at, np.arange(slots + 1, dtype=np.uint64))
        total = np.zeros(len(elements) + 1, np.uint64)
        np.cumsum(mix64(elements + np.uint64(i)), out=total[1:])
        sums = (total[edges[1:]] - total[edges[:-1]]).reshape(b.groups, PARTITIONS)
        counts = np.diff(edges).reshape(b.groups, PARTITIONS)
        sigs, held = [], []
        for s, subset in enumerate(SUBSETS):
            h = np.full(b.groups, (i << 8) + s, np.uint64) + np.arange(b.groups, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for p in subset:
                h = mix64(h) + sums[:, p]
            sigs.append((mix64(h) & ~np.uint64(255)) | np.uint64(i))
            held.append(counts[:, list(subset)].sum(1))
        sig, size = np.concatenate(sigs), np.concatenate(held)
        thin = min(spare, int((size < LEAST_ELEMENTS).sum()))
        out.append(sig[np.lexsort((sig, size))[thin:]])
        rest.append(np.full(len(out[-1]), spare - thin, np.int16))
    return np.concatenate(out), np.concatenate(rest)


def parity(elements: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Bit i: whether an odd number of elements falls into slot i. Bits that differ bound the difference from below."""
    k = band(_index(len(elements), similarity), similarity).k
    width = max(64, 1 << max(0, SLOTS * k - 1).bit_length())
    slots = np.bincount((elements & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(slots.astype(np.uint8), bitorder="little")


def _sets(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The sets of whole documents, some at a time, with the index of the first."""
    for c in chunks(texts):
        hashes, first = word_hashes(c)
        yield c.first, [shingles(hashes[first[k] : first[k + 1]], width) for k in range(len(c))]


def _named(width: int):
    """(id, n, h1, h2) of (id, text): the set's size and 128 bits that stand for it."""

    def total(e: np.ndarray, salt: int) -> np.uint64:
        return np.add.reduce(mix64(e ^ np.uint64(salt))) if len(e) else np.uint64(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets(batch.column(1), width):
                h1, h2 = (pa.array(np.array([total(e, salt) for e in sets], np.uint64).view(np.int64)) for salt in (0, 0x5851F42D4C957F2D))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array([len(e) for e in sets], pa.int64()), h1, h2], names=["id", "n", "h1", "h2"])

    return run


def _signed(width: int, similarity: Fraction):
    """(id, n, sigs, rest, bits) of (id, text), for sets that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets(batch.column(1), width):
                some = [k for k, e in enumerate(sets) if len(e)]
                if not some:
                    continue
                sigs, rest = zip(*(signatures(sets[k], similarity) for k in some), strict=True)
                offsets = np.zeros(len(sigs) + 1, np.int32)
                np.cumsum([len(s) for s in sigs], out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.array(some) + first)),
                        pa.array([len(sets[k]) for k in some], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rest))),
                        pa.array([parity(sets[k], similarity).tobytes() for k in some], pa.binary()),
                    ],
                    names=["id", "n", "sigs", "rest", "bits"],
                )

    return run


def _verify(width: int, similarity: Fraction):
    """(a, b, linked) of rows (a, b, text) where a's own text, with null b, comes before those of its partners."""
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # an id may have several texts
        hub = None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for first, sets in _sets(batch.column(2), width):
                for k, own in enumerate(sets, first):
                    if a[k] != hub:
                        hub, held = a[k], []
                    if b[k] is None:
                        held.append(own)
                        continue
                    linked = False
                    for other in held:
                        both = len(own) + len(other)
                        common = both - len(np.union1d(own, other))
                        linked |= q * common >= p * (both - common)
                    out.append((a[k], b[k], linked))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "linked"])

    return run


@dataclass
class Join:
    """sets: (id, n, h1, h2, rep) of all documents; labels: (node, component) of the representatives with links."""

    sets: DataFrame
    labels: DataFrame


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, similarity: float | Fraction = Fraction(9, 10)) -> Join:
    similarity = Fraction(similarity).limit_denominator(1000)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = materialize(rows.mapInArrow(lean(_named(width)), "id long, n long, h1 long, h2 long"), "named")
    sets = materialize(with_least(found, ["h1", "h2", "n"], "id", "rep").withColumn("rep", F.expr("CASE WHEN n > 0 THEN rep END")), "classes")
    discard(found)
    # Ids that stand for no class need no signatures.
    copies = sets.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.max(F.col("id") == F.col("rep")).alias("own")).where("NOT own")
    signed = materialize(rows.where("id IS NOT NULL").join(copies, "id", "left_anti").mapInArrow(lean(_signed(width, similarity)), "id long, n long, sigs array<long>, rest array<smallint>, bits binary"), "signed")
    bits = materialize(signed.select("id", "n", "bits"), "bits")
    by_sig = signed.select("id", F.explode("sigs").alias("sig"))
    # Counts by signature are combined before their shuffle; the rows of one met twice follow, where AQE splits skewed keys.
    several = by_sig.groupBy("sig").agg(F.min("id").alias("low"), F.max("id").alias("top"), F.count("*").alias("size"))
    several = materialize(several.where("low <> top").select("sig", "size"), "several")
    with_rest = signed.select("id", F.explode(F.arrays_zip("sigs", "rest")).alias("x")).select("id", F.col("x.sigs").alias("sig"), F.col("x.rest").alias("rest"))
    # A set goes without the most frequent of its signatures, as many as its band still spares.
    last = Window.partitionBy("id", F.col("sig").bitwiseAND(255)).orderBy(F.desc("size"), F.desc("sig"))
    left = with_rest.join(several, "sig").withColumn("place", F.row_number().over(last)).where("place > rest").select("sig", "id").distinct()
    left = materialize(left, "shared")
    discard(signed, several)
    labels, spent = None, [left]
    # Two hubs in turn meet those of other components; then classes still apart meet in blocks,
    # first by a forest of likely links, and where one of those fails by all that the bits let pass.
    for step in ("hub", "hub", "forest", "all"):
        apart = _apart(left, labels)
        if step == "hub":
            likely = apart.where("c <> hub.c").select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
        else:
            likely = _likely(apart, bits, similarity, step == "forest")
        got = _checked(likely, bits, rows, width, similarity)
        links = got.where("linked").select("a", "b")
        merged = materialize(components(links), "labels") if labels is None else _merged(labels, links)
        if step == "hub":  # which has met all of its signature
            left = apart.where("id <> hub.id").select("sig", "id")
        elif step == "forest":
            ends = got.where("NOT linked").select(F.explode(F.array("a", "b")).alias("id")).distinct()
            left = apart.join(ends, "id", "left_semi").select("sig").distinct().join(apart.select("sig", "id"), "sig")
        discard(*spent, *([] if labels is None else [labels]))
        labels, spent = merged, [apart, got]
    discard(*spent, bits)
    collect_garbage(docs.sparkSession)
    return Join(sets, labels)


def _apart(left: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows (sig, id) of signatures with several components, with c, the component, the hub (id, c) and the number of rows."""
    if labels is None:
        named = left.withColumn("c", F.col("id"))
    else:
        label = labels.select(F.col("node").alias("id"), F.col("component").alias("c"))
        named = materialize(left.join(label, "id", "left").select("sig", "id", F.coalesce("c", "id").alias("c")), "components")
    groups = named.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct("id", "c")).alias("hub"), F.count("*").alias("size"))
    groups = materialize(groups.where("c0 <> c1").select("sig", "hub", "size"), "groups")
    apart = materialize(named.join(groups, "sig"), "apart")
    discard(groups, *([] if labels is None else [named]))
    return apart


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, component) after further links: components of the graph of components."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("component").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    over = components(ends.select("a", "b"))
    mapped = labels.join(over.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    new = over.join(labels, "node", "left_anti")
    return materialize(mapped.union(new.select("node", "component")), "labels")


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity bits over fewer slots: halves laid over each other."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def likely_links(ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, bits: list[bytes], similarity: Fraction, forest: bool) -> Iterator[np.ndarray]:
    """Index pairs that may be similar and would join components, the nearest in parity bits first.

    Any other pair of two components is out of reach of the similarity. With forest, only a
    spanning forest of the components and some pairs more.
    """
    p, q = similarity.numerator, similarity.denominator
    small = min(map(len, bits))
    b = np.stack([_fold(np.frombuffer(x, np.uint8), small) for x in bits]).view(np.uint64)
    n, c = sizes, np.unique(comps, return_inverse=True)[1]
    found = []
    for k in range(len(ids) - 1):
        other = np.flatnonzero((c[k + 1 :] != c[k]) & (q * n[k + 1 :] >= p * n[k]) & (q * n[k] >= p * n[k + 1 :])) + k + 1
        if len(other):
            d = np.bitwise_count(b[other] ^ b[k]).sum(1, dtype=np.int64)
            near = (p + q) * d <= (q - p) * (n[other] + n[k])
            found.append(np.stack([d[near], np.full(near.sum(), k), other[near]], 1).astype(np.int32))
    if not found:
        return
    pairs = np.concatenate(found)
    if not forest:
        for at in range(0, len(pairs), PART):
            yield pairs[at : at + PART, 1:]
        return
    root = list(range(int(c.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    spare = len(ids)
    order = np.argsort(pairs[:, 0], kind="stable")
    for at in range(0, len(order), PART):
        out = []
        part = pairs[order[at : at + PART], 1:]
        for k, (i, j) in enumerate(part.tolist()):
            x, y = find(int(c[i])), find(int(c[j]))
            if x != y:
                root[x] = y
            elif spare:  # some of the next ones as well, in case that one fails
                spare -= 1
            else:
                continue
            out.append(k)
        yield part[out]


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about PART rows, whatever number of groups they come from."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= PART:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _likely(apart: DataFrame, bits: DataFrame, similarity: Fraction, forest: bool) -> DataFrame:
    """(a, b): likely_links of each signature, by pairs of blocks of its classes."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = apart.select("sig", "id", "c", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("o"))
    rows = rows.select("sig", "id", "c", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j")).join(bits, "id")
    rows = rows.select("sig", "i", "j", "id", "c", "n", "bits").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "id")

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ids, comps, sizes = (table.column(k).to_numpy() for k in (3, 4, 5))
        if len(ids) < 2 or comps.min() == comps.max():
            return
        for at in likely_links(ids, comps, sizes, table.column(6).to_pylist(), similarity, forest):
            ends = np.sort(ids[at], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, k]) for k in range(2)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if (now := keys[x].tolist()) != key:
                    if held:
                        yield from pairs(held)
                    key, held = now, []
                held.append(batch.slice(x, y - x))
        if held:
            yield from pairs(held)

    return rows.mapInArrow(lean(lambda batches: _joined(run(batches))), "a long, b long").where("a <> b").distinct()


def _checked(pairs: DataFrame, bits: DataFrame, rows: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """pairs(a, b) that pass the bounds on size and parity bits, with whether they are linked.

    Partners of one a that one task wrote share a slice; a's text is sent once a slice, not once a pair.
    """
    p, q = similarity.numerator, similarity.denominator
    x, y = bits.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), bits.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    near = pairs.join(y, "b").join(x, "a").where((F.col("na") * q >= F.col("nb") * p) & (F.col("nb") * q >= F.col("na") * p))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, xa, xb in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                u, v = np.frombuffer(xa, np.uint8), np.frombuffer(xb, np.uint8)
                u, v = _fold(u, len(v)), _fold(v, len(u))
                keep.append((p + q) * int(np.bitwise_count(u ^ v).sum()) <= (q - p) * (na + nb))
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["a", "b"])

    near = near.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(lean(bounded), "a long, b long")
    near = materialize(near.withColumn("slice", F.spark_partition_id()), "pairs")
    texts = rows.where("id IS NOT NULL")
    hubs = near.select("a", "slice").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "text", "slice")
    partners = near.join(texts.withColumnRenamed("id", "b"), "b").select("a", "b", "text", "slice")
    both = hubs.union(partners).repartition("a", "slice").sortWithinPartitions("a", "slice", F.asc_nulls_first("b")).select("a", "b", "text")
    got = both.mapInArrow(lean(_verify(width, similarity)), "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))
    got = materialize(got, "checked")
    discard(near)
    return got


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, similarity: float | Fraction = Fraction(9, 10)) -> DataFrame:
    """(id, n_shingles, component_id) for every row; component_id is the least id reachable by links.

    Ids are integers. Null and wordless texts have an empty set and are alone; a null id belongs to
    the component of its set, if any; repeated rows each give a row.
    """
    join = similar_sets(docs, id_col, text_col, width=width, similarity=similarity)
    labels = join.labels.withColumnRenamed("node", "rep")
    return join.sets.join(labels, "rep", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def op3_near_duplicates(docs: DataFrame) -> DataFrame:
    """The least doc_id that links reach, for every row; odd rows as in near_duplicates."""
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")


def keep_one_of_each(docs: DataFrame, *, width: int = 5, similarity: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """Of each component of near duplicates one row stays, that of the least id; null ids come last.

    Where ids repeat or are null, rows are numbered first, so that each row is judged by its own text.
    """
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        got = near_duplicates(docs, width=width, similarity=similarity)
        gone = materialize(got.where("component_id <> id").select(F.col("id").alias("_gone")).distinct(), "gone")
        return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    got = near_duplicates(rows, "_row", width=width, similarity=similarity).join(rows.select(F.col("_row").alias("id"), "doc_id"), "id")
    first = got.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("m"))
    kept = materialize(first.select(F.col("m.id").alias("_row")), "kept")
    return rows.join(kept, "_row", "left_semi").drop("_row")
