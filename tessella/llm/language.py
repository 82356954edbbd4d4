"""Language identification: the family first, then pairs of languages within it.

Documents become hashed byte-trigram profiles. A linear support vector machine for each family
against the rest picks the family; one-versus-one linear machines vote among its languages.
The fit reads at most `per_language` labelled documents of each label, chosen by the least hash
of their id; prediction reads every document whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textvec import LOWER, Chunk, chunks, lean, release
from .work import collect_garbage

DIMS = 4096
UNKNOWN = "und"
#: Language families by label; any other label is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu", "ur"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "semitic": ("ar", "he", "mt"),
}
_LETTER = regex.compile(r"\p{L}")
_LETTERS = np.zeros(256, bool)
_LETTERS[ord("a") : ord("z") + 1] = True
_LETTERS[128:] = True


def profiles(chunk: Chunk) -> np.ndarray:
    """One row for each document: square roots of trigram shares, of Euclidean length 1."""
    n = len(chunk)
    b = LOWER[chunk.data]
    lead = np.flatnonzero(b == 0xC3)
    lead = lead[lead + 1 < len(b)]
    follow = b[lead + 1]
    upper = lead[(follow >= 0x80) & (follow <= 0x9E) & (follow != 0x97)] + 1
    b[upper] += 0x20
    b[~_LETTERS[b]] = 0x20
    out = np.zeros((n, DIMS), np.float32)
    if len(b) >= 3:
        code = b[:-2].astype(np.uint32) | b[1:-1].astype(np.uint32) << 8 | b[2:].astype(np.uint32) << 16
        doc = np.repeat(np.arange(n), np.diff(chunk.offsets))
        keep = (doc[:-2] == doc[2:]) & (code != 0x202020)
        slot = (code[keep] * np.uint32(0x9E3779B1)) >> np.uint32(20)
        out = np.bincount(doc[:-2][keep] * DIMS + slot, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 250) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    rate = 1.0 / (1.0 / c + 4.0)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = v / c - 2 * x.T @ (share * y * slack)
        new = v - rate * grad
        v, w = new + (k / (k + 3)) * (new - w), new
    return w[:-1], float(w[-1])


@dataclass
class LanguageModel:
    """family_of: by label; heads: one machine for each family; pairs: by two labels."""

    labels: list[str] = field(default_factory=list)
    family_of: dict[str, str] = field(default_factory=dict)
    heads: dict[str, tuple] = field(default_factory=dict)
    pairs: dict[tuple[str, str], tuple] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, families: dict[str, tuple]) -> LanguageModel:
        labels = sorted(set(y.tolist()))
        named = {code: name for name, codes in families.items() for code in codes}
        family_of = {k: named.get(k, f"={k}") for k in labels}
        kin = np.array([family_of[k] for k in y.tolist()])
        out = cls(labels, family_of)
        for name in sorted(set(kin.tolist())):
            if len(set(kin.tolist())) > 1:
                out.heads[name] = fit_svm(x, np.where(kin == name, 1, -1).astype(np.float32))
            members = [k for k in labels if family_of[k] == name]
            for a, b in combinations(members, 2):
                own = (y == a) | (y == b)
                out.pairs[a, b] = fit_svm(x[own], np.where(y[own] == a, 1, -1).astype(np.float32))
        return out

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels and scores. A score is the product of the logistic values of the deciding margins."""
        n = len(x)
        if not self.labels:
            return np.full(n, UNKNOWN, object), np.zeros(n)
        likely = lambda margin: 1 / (1 + np.exp(-4.0 * margin.astype(np.float64)))
        names = sorted(set(self.family_of.values()))
        family, score = np.zeros(n, np.int64), np.ones(n)
        if self.heads:
            margins = np.stack([x @ self.heads[k][0] + self.heads[k][1] for k in names], 1)
            family = margins.argmax(1)
            top = np.sort(margins, 1)
            score = likely((top[:, -1] - top[:, -2]) / 2)
        out = np.full(n, UNKNOWN, object)
        for f, name in enumerate(names):
            rows = np.flatnonzero(family == f)
            members = [k for k in self.labels if self.family_of[k] == name]
            votes, weakest = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), np.inf)
            for (a, b), (w, bias) in self.pairs.items():
                if a in members:
                    i, j = members.index(a), members.index(b)
                    margin = x[rows] @ w + bias
                    votes[:, i] += margin > 0
                    votes[:, j] += margin <= 0
                    weakest[:, i], weakest[:, j] = np.minimum(weakest[:, i], margin), np.minimum(weakest[:, j], -margin)
            # A tie of votes goes to the label whose weakest margin is the largest.
            best = np.lexsort((np.where(np.isinf(weakest), 0, weakest), votes), axis=1)[:, -1] if len(members) > 1 else np.zeros(len(rows), np.int64)
            out[rows] = np.array(members, object)[best]
            if len(members) > 1:
                score[rows] *= likely(weakest[np.arange(len(rows)), best])
        return out, score


#: Hash places of ids.
PLACES = 1 << 20


def held_out(doc_id: Column, parts: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == remainder, F.lit(False))


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = 400, families: dict[str, tuple] | None = None) -> LanguageModel:
    """Fit on at most per_language documents of each label with a text; rows without a label don't count."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (F.length("text") > 0))
    # A label's ids by hash: those below a bound that some four times per_language are expected under, so
    # what meets in one window does not grow with the label; then the least of them.
    place = F.pmod(F.xxhash64("id"), F.lit(PLACES))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    # One row a label, of which the model holds per_language profiles here: no row is dealt by its label.
    few = known.select("id", "lang", place.alias("place")).join(F.broadcast(sizes), "lang").where(F.col("place") * F.col("n") < 4 * per_language * PLACES)
    order = Window.partitionBy("lang").orderBy("place", "id")
    picked = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("id", "lang")
    # At most per_language ids of each label.
    sample = known.join(F.broadcast(picked.distinct()), ["id", "lang"]).select("id", "lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2), 1 << 18):
                x = profiles(c)
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, len(c)).cast(pa.string()), batch.column(1).slice(c.first, len(c)), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(x, at, strict=True)], pa.list_(pa.float32()))], ["id", "lang", "at", "value"])

    got = sample.mapInArrow(lean(features), "id string, lang string, at array<int>, value array<float>").toArrow().sort_by([("lang", "ascending"), ("id", "ascending")])
    x = np.zeros((got.num_rows, DIMS), np.float32)
    for k, (at, value) in enumerate(zip(got["at"], got["value"], strict=True)):
        x[k, at.values.to_numpy()] = value.values.to_numpy()
    model = LanguageModel.fit(x, np.array(got["lang"].to_pylist(), object), families or FAMILIES) if len(x) else LanguageModel()
    del got, x
    release()
    collect_garbage(docs.sparkSession)
    return model


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), label: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns in keep with a label and a score from 0 to 1.

    A null text or one without a letter is `und` with score 0, and so is any text if nothing was
    learned. Rows are neither dropped nor merged; other columns are never read.
    """
    rows = docs.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)], F.col(text_col).alias("_text"))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], f"`{label}` string", f"`{score}` double"])
    names = [*keep, label, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            for c in chunks(texts, 1 << 18):
                got, sure = model.predict(profiles(c))
                own = texts.slice(c.first, len(c))
                for k, t in enumerate(own):
                    if not t.is_valid or not _LETTER.search(t.as_py()):
                        got[k], sure[k] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(c.first, len(c)) for k in range(len(keep))], pa.array(got.tolist(), pa.string()), pa.array(sure, pa.float64())], names=names)

    return rows.mapInArrow(lean(run), schema)


def op7_language(docs: DataFrame) -> DataFrame:
    """The contract's digest: one row for each document, learned from those with crc32 mod 5 not 0."""
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit_language_model(docs.where(~out & F.col("doc_id").isNotNull()))
    return predict_language(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Documents with an identified language, whose label becomes lang; rejected ones go.

    Rejected: no text, no letter, or a score below min_score. The model learns from all labelled rows.
    """
    model = fit_language_model(docs)
    names = docs.columns
    got = predict_language(docs, model, keep=tuple(names), label="_lang", score="_score")
    return got.where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= min_score)).select(*[F.col("_lang").alias("lang") if c == "lang" else F.col(c) for c in names])
