"""Language-model scores: the marginal likelihood of a text over all segmentations into subwords.

The pieces of a public subword vocabulary are a unigram model: the order in which its file lists
them gives the first weights, and passes of expectation-maximisation over the training words give
those in use. A word's probability sums over all its segmentations, by a forward recursion in log
space over the word's lattice; a text's score adds those of its words and its end.

All training words count: what is gathered grows with the input. Words that are more than a fixed
share of all tokens, so of a bounded number, go to every task; the others of a block of texts meet
the corpus counts in a join, once a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .textvec import BYTE_VALUE, LOWER, Chunk, chunks, lean, span_hashes, words
from .work import materialize

PIECES = "piece_bpe_32k.model"
#: Stands for the end of a text among its words.
END = ""
#: Bytes of text whose rare words are looked up together, or one document if that is longer.
BLOCK_BYTES = 4 << 20
#: Distinct words that a task counts before it hands them on.
MOST_WORDS = 300_000
#: A word that is more than one token in so many is frequent; there are fewer of them than this.
FREQUENT = 200_000
#: Passes of expectation-maximisation.
PASSES = 2
#: Words of up to so many characters are scored side by side, longer ones alone.
MOST_CHARS = 64
#: Substrings looked up at a time.
CELLS = 1 << 20
TABLE_BITS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _dictionary(c: Chunk) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct lower-cased words, number of each word, number of words of each document)."""
    low = LOWER[c.data]
    starts, ends, first = words(c)
    _, where, word = np.unique(span_hashes(BYTE_VALUE[low], starts, ends), return_index=True, return_inverse=True)
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], word, np.diff(first)


def _text(word: bytes) -> str:
    return word.decode("utf-8", "replace")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) of the texts of (text); END once for each text."""

    def out(total: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(map(_text, total)), pa.array(total.values(), pa.int64())], names=["word", "c"])

    total: dict[bytes, int] = {}
    for batch in batches:
        for c in chunks(batch.column(0)):
            names, word, _ = _dictionary(c)
            for w, k in zip(names, np.bincount(word, minlength=len(names)).tolist(), strict=True):
                total[w] = total.get(w, 0) + k
            total[b""] = total.get(b"", 0) + len(c)
            if len(total) > MOST_WORDS:
                yield out(total)
                total = {}
    if total:
        yield out(total)


def _blocks(frequent: list[tuple[str, int, float]], weights: list[float], ends: int, unseen: float):
    """Blocks of texts (id, held, text): sums over frequent words and ends, and the rare words with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(weights)
        at = {w.encode(): k for k, (w, _, _) in enumerate(frequent)}
        base = np.append(np.log10(np.array([c for _, c, _ in frequent]) + 1), 0.0) + unseen
        known = np.append(np.ones(len(at)), 0)
        lp = np.append([x for _, _, x in frequent], 0.0)
        number = TaskContext.get().partitionId() << 32
        rare: dict[bytes, int] = {}
        parts: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            names = [_text(w) for w in rare]
            ids, held, docs, pairs = zip(*parts, strict=True)
            docs = [np.concatenate(x) for x in zip(*docs, strict=True)]
            lengths, word, times = (np.concatenate(x) for x in zip(*pairs, strict=True))
            own = lattice.scores(names) / log(10)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            docs[3] = docs[3] + np.bincount(doc, own[word] * times, len(lengths))
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    one(names, pa.string()),
                    one(pa.concat_arrays(ids).to_pylist(), pa.int64()),
                    one(pa.concat_arrays(held).to_pylist(), pa.bool_()),
                    one(docs[0].astype(np.int64), pa.int64()),
                    one(docs[1].astype(np.int64), pa.int64()),
                    one(docs[2], pa.float64()),
                    one(docs[3], pa.float64()),
                    one(lengths, pa.int32()),
                    one(word, pa.int32()),
                    one(times, pa.int32()),
                ],
                names=["block", "words", "ids", "held", "tokens", "known", "base", "score", "lengths", "word", "times"],
            )

        for batch in batches:
            for c in chunks(batch.column(2)):
                if parts and size + len(c.data) > BLOCK_BYTES:
                    yield row()
                    number, rare, parts, size = number + 1, {}, [], 0
                names, word, count = _dictionary(c)
                n = len(c)
                doc = np.repeat(np.arange(n), count)
                place = np.array([at.get(w, -1) for w in names], np.int64)
                add = lambda x: np.bincount(doc, x[place[word]], n)  # noqa: B023, E731
                few = place[word] < 0
                fresh = {k: rare.setdefault(names[k], len(rare)) for k in np.flatnonzero(place < 0).tolist()}
                place[list(fresh)] = list(fresh.values())
                pair, times = np.unique((doc[few] << 32) | place[word[few]], return_counts=True)
                place[list(fresh)] = -1
                # The last row stands for rare words: their base comes with their counts.
                sums = [count + 1.0, add(known) + (ends > 0), add(np.append(base[:-1], 0.0)) + np.log10(ends + 1) + unseen, add(lp) + lattice.weight[lattice.end] / log(10)]
                pairs = (np.bincount(pair >> 32, minlength=n).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32))
                parts.append((batch.column(0).slice(c.first, n), batch.column(1).slice(c.first, n), sums, pairs))
                size += len(c.data)
        if parts:
            yield row()

    return run


def _pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))


class Lattice:
    """Marginal log probabilities of words under log weights of pieces; characters without a piece go by their bytes."""

    def __init__(self, weights: list[float] | None = None):
        model = _pieces()
        size = model.get_piece_size()
        self.weight = np.array(weights if weights is not None else first_weights(model))
        self.end = model.eos_id()
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.piece = {model.id_to_piece(i): i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.longest = max(map(len, self.piece))
        self.starts = {p[:k] for p in self.piece for k in range(1, len(p))}
        hashes = np.zeros(len(self.piece), np.uint64)
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(self.piece):
            by_length.setdefault(len(p), []).append(k)
        names, ids = list(self.piece), np.array(list(self.piece.values()))
        for n, at in by_length.items():
            for h in _rolled(_code_points([names[k] for k in at], n), n):
                hashes[at] = h[:, 0]
        self.hashes, self.ids = hashes, ids
        self.scored = np.append(self.weight, -np.inf)  # of id -1
        # Pieces by the first bits of their hashes; those whose place another took stand in a second table.
        at = np.arange(len(hashes))
        self.tables = [(np.uint64(1), self._table(at, _slots(hashes)))]
        other = at[self.tables[0][1][_slots(hashes)] != at]
        salt = np.uint64(3)
        while len(np.unique(_slots(hashes[other] * salt))) < len(other):
            salt += np.uint64(2)
        self.tables.append((salt, self._table(other, _slots(hashes[other] * salt))))

    @staticmethod
    def _table(at: np.ndarray, slots: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << TABLE_BITS, np.int32)
        table[slots] = at
        return table

    def _char(self, c: str) -> tuple[float, list[int]]:
        """The log weight of one character and the pieces that it stands for."""
        at = [self.piece[c]] if c in self.piece else [self.byte[b] for b in c.encode()]
        return float(self.weight[at].sum()), at

    def _arcs(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of shape (length - 1, start, word); id -1 where there is no piece."""
        n, size = points.shape
        ids = np.full((min(self.longest, size), size, n), -1, np.int32)
        for k, h in enumerate(_rolled(points, self.longest)):
            for salt, table in self.tables:
                at = table[_slots(h * salt)]
                row, start = np.nonzero(self.hashes[at] == h)
                ids[k, start, row] = self.ids[at[row, start]]
        scores = self.scored[ids]
        for c in np.unique(points[(ids[0] < 0).T]).tolist():
            scores[0][points.T == c] = self._char(chr(c))[0]
        return ids, scores

    def _forward(self, scores: np.ndarray) -> np.ndarray:
        most, size, n = scores.shape
        ahead = np.zeros((size + 1, n))
        for j in range(1, size + 1):
            k = np.arange(min(most, j))
            ahead[j] = _log_sum(ahead[j - 1 - k] + scores[k, j - 1 - k])
        return ahead

    def scores(self, words: list[str]) -> np.ndarray:
        """Natural log of the summed probability of all segmentations of each word and the mark before it."""
        out = np.zeros(len(words))
        for at, points in _by_length(words, self.longest):
            out[at] = self.score(words[at[0]]) if points is None else self._forward(self._arcs(points)[1])[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over the words, each as often as counts tells."""
        total = np.zeros(len(self.weight))
        for at, points in _by_length(words, self.longest):
            if points is None:
                self._expected_long(words[at[0]], float(counts[at[0]]), total)
                continue
            ids, scores = self._arcs(points)
            most, size, n = scores.shape
            ahead = self._forward(scores)
            after = np.zeros((size + 1, n))
            for i in range(size - 1, -1, -1):
                k = np.arange(min(most, size - i))
                after[i] = _log_sum(after[i + 1 + k] + scores[k, i])
            use = np.zeros_like(scores)
            for k in range(most):
                use[k, : size - k] = np.exp(ahead[: size - k] + scores[k, : size - k] + after[k + 1 :] - ahead[-1])
            use *= counts[at]
            known = ids >= 0
            total += np.bincount(ids[known], use[known], len(total))
            chars, by = np.unique(points.T[~known[0]], return_inverse=True)
            for c, u in zip(chars.tolist(), np.bincount(by, use[0][~known[0]], len(chars)).tolist(), strict=True):
                total[self._char(chr(c))[1]] += u
        return total

    def _long_arcs(self, text: str, i: int) -> Iterator[tuple[int, float, list[int]]]:
        """(end, score, pieces) of the arcs that start at i."""
        for j in range(i + 1, min(i + self.longest, len(text)) + 1):
            p = text[i:j]
            if p in self.piece:
                yield j, float(self.weight[self.piece[p]]), [self.piece[p]]
            elif j == i + 1:
                yield j, *self._char(p)
            if p not in self.starts:
                break

    def _long_ahead(self, text: str) -> Iterator[float]:
        """The log sums up to each border, holding as many as the longest piece spans."""
        size = self.longest + 1
        ring: list[list[float]] = [[] for _ in range(size)]
        ring[0] = [0.0]
        for i in range(len(text) + 1):
            terms, ring[i % size] = ring[i % size], []
            top = max(terms)
            here = top + log(sum([exp(t - top) for t in terms]))
            yield here
            if i < len(text):
                for j, s, _ in self._long_arcs(text, i):
                    ring[j % size].append(here + s)

    def score(self, word: str) -> float:
        """The score of one word of any length."""
        here = 0.0
        for here in self._long_ahead("▁" + word):  # noqa: B007
            pass
        return here

    def _expected_long(self, word: str, count: float, total: np.ndarray) -> None:
        text = "▁" + word
        ahead = np.fromiter(self._long_ahead(text), float, len(text) + 1)
        after = np.zeros(len(text) + 1)
        for i in range(len(text) - 1, -1, -1):
            arcs = list(self._long_arcs(text, i))
            terms = [after[j] + s for j, s, _ in arcs]
            top = max(terms)
            after[i] = top + log(sum(exp(t - top) for t in terms))
            for (_, _, at), t in zip(arcs, terms, strict=True):
                total[at] += count * exp(ahead[i] + t - ahead[-1])


def first_weights(model) -> list[float]:
    """Log weights by rank: the file's scores order the pieces, those for bytes last, but are no probabilities."""
    size = model.get_piece_size()
    score = np.array([-np.inf if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) else model.get_score(i) for i in range(size)])
    raw = np.zeros(size)
    raw[np.argsort(-score, kind="stable")] = 1 / np.arange(2, size + 2)
    return np.log(raw / raw.sum()).tolist()


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _log_sum(terms: np.ndarray) -> np.ndarray:
    # One character is always an arc, so no column is empty.
    top = terms.max(0)
    return top + np.log(np.exp(terms - top).sum(0))


def _code_points(texts: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), size).astype(np.uint64)


def _rolled(points: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each width up to longest, hashes of all runs of so many code points in each row."""
    size = points.shape[1]
    h = np.zeros_like(points)
    for k in range(min(longest, size)):
        h = (h[:, : size - k] ^ points[:, k:]) * _BASE
        h ^= h >> np.uint64(29)
        h *= _BASE
        h ^= h >> np.uint64(32)
        yield h


def _by_length(words: list[str], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Places and code points, with the mark before, of words of one length; long words come alone, without."""
    length = np.array([len(w) for w in words])
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        if n > MOST_CHARS:
            yield from ((at[k : k + 1], None) for k in range(len(at)))
            continue
        step = max(1, CELLS // ((n + 1) * min(longest, n + 1)))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield part, _code_points(["▁" + words[x] for x in part], n + 1)


def fitted_weights(counts: DataFrame, texts: int) -> list[float]:
    """Log weights of the pieces after PASSES over counts(word, c) of the training words and their number of ends."""
    weights = Lattice().weight
    end, size = Lattice().end, len(weights)
    for _ in range(PASSES):
        now = weights.tolist()

        def expect(batches: Iterator[pa.RecordBatch], now: list[float] = now) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(now), np.zeros(len(now))
            for batch in batches:
                total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "uses"])

        # At most one row for each piece of the vocabulary.
        found = counts.mapInArrow(lean(expect), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        total = np.ones(size)
        for r in found:
            total[r["piece"]] += r["uses"]
        total[end] += texts
        weights = np.log(total / total.sum())
    return weights.tolist()


def score_documents(docs: DataFrame, held: str = "held", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, held, n_tokens, n_known, train_tokens, base_score, score) for every row.

    score is the log10 of the product, over words and the end, of their marginal probabilities over
    all segmentations; each piece's weight is its expected use in the training words, plus one. Learns from the rows where held is false. Null texts count as empty: their end is their one
    token. Repeated rows count each; null ids are allowed. Without training rows N and V are 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(held), F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    # A task hands on each word once for many texts: a frequent word sends one row a task.
    found = rows.where("NOT held").select("text").mapInArrow(lean(_count_words), "word string, c long")
    counts = materialize(found.groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0))).first()
    counts = counts.where(F.col("word") != END)
    weights = fitted_weights(counts, ends)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(weights)
        for batch in batches:
            lp = lattice.scores(batch.column(0).to_pylist()) / log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lp)], names=["word", "c", "lp"])

    # Fewer than FREQUENT rows, as their counts add up to n at most.
    often = F.col("c") * FREQUENT > n
    frequent = [tuple(r) for r in counts.where(often).mapInArrow(lean(scored), "word string, c long, lp double").collect()]
    unseen = float(np.log10(1 / (n + v + 1)))
    kinds = "block long, words array<string>, ids array<long>, held array<boolean>, tokens array<long>, known array<long>, base array<double>, score array<double>, lengths array<int>, word array<int>, times array<int>"
    blocks = materialize(rows.mapInArrow(lean(_blocks(frequent, weights, ends, unseen)), kinds), "blocks")
    places = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("at", "word"))
    looked = places.join(counts.where(~often), "word").select("of", "at", "c")

    def finished(block: pa.Table, found: pa.Table) -> pa.Table:
        own = block.to_batches()[0]
        ids, held, tokens, known, base, score, lengths, word, times = (own.column(f)[0].values for f in ("ids", "held", "tokens", "known", "base", "score", "lengths", "word", "times"))
        lengths, word, times = (x.to_numpy() for x in (lengths, word, times))
        c = np.zeros(int(word.max()) + 1 if len(word) else 0)
        if found.num_rows:
            c[found.column("at").to_numpy()] = found.column("c").to_numpy()
        doc = np.repeat(np.arange(len(ids)), lengths)
        add = lambda x: np.bincount(doc, x[word] * times, len(ids))
        return pa.table(
            {
                "id": ids,
                "held": held,
                "n_tokens": tokens,
                "n_known": pa.array(known.to_numpy() + add(c > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(ids), n, np.int64)),
                "base_score": pa.array(base.to_numpy() + add(np.log10(c + 1) + unseen)),
                "score": score,
            }
        )

    # A group is one block and its distinct rare words: bounded by BLOCK_BYTES or one document.
    both = blocks.drop("words").groupBy("block").cogroup(looked.groupBy("of"))
    return both.applyInArrow(finished, "id long, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_score(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learned from those whose crc32(doc_id as text) mod 7 is not 2.

    Null and empty texts have one token, their end; repeated rows each count and give a row; a null
    id is never held out.
    """
    rows = docs.select(F.col("doc_id").alias("id"), held_out(F.col("doc_id"), 7, 2).alias("held"), "text")
    return score_documents(rows).withColumnsRenamed({"id": "doc_id", "held": "held_out"})
