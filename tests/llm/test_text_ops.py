"""Text operators against brute force, on small and odd tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import fingerprint, language, linededup, lmscore, mixing, packing, partenum, personal, tokenize, work
from tessella.llm.components import components
from tessella.llm.textvec import chunks, shingles, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, site string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(spark, rows):
    """rows: (doc_id, text, lang, source); with columns whose names clash with the operators'."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, 7, "x", None) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls everywhere, empty, blank and very long texts, ties and repeated rows, astral characters."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = [(k, base[k % 6] + ("" if k < 6 else f" {word()}"), ("en", "de", "fr")[k % 3], f"s{k % 4}") for k in range(24)]
    rows += [(30, None, "en", "s0"), (31, "", None, "s1"), (32, " \t\n\x0b\x0c\r ", "en", None), (33, "a", "en", None), (34, "A b", "en", "s1"), (None, base[0], "en", "s0"), (None, None, None, None)]
    rows += [(35, "x" * 70_000 + " " + base[1] * 40, "en", "s2"), (36, "🙂 ñandú 漢字 don't it's x　y", "es", "s3"), (36, "🙂 ñandú 漢字 don't it's x　y", "es", "s3")]
    return rows


def brute_components(rows, width, similarity):
    sets = {}
    for d, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and Fraction(both, len(sets[a] | sets[b])) >= similarity:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("width", "similarity"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_components_equal_brute_force(spark, width, similarity):
    rng = random.Random(width)
    rows = []
    for group in range(5):
        base = [rng.choice("abcdefghijkl") * rng.randint(1, 3) for _ in range(rng.choice([4, 12, 40, 150]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 15))):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(w), "en", "s"))
    got = {r.id: (r.n_shingles, r.component_id) for r in partenum.near_duplicates(table(spark, rows), width=width, similarity=similarity).collect()}
    assert got == brute_components(rows, width, similarity)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 3)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(20):
        base = list(base)
        base[rng.randrange(60)] = f"n{k}"  # each near the one before
        rows.append((k, " ".join(base), "en", "s"))
    got = {r.id: (r.n_shingles, r.component_id) for r in partenum.near_duplicates(table(spark, rows), width=1, similarity=Fraction(19, 20)).collect()}
    assert got == brute_components(rows, 1, Fraction(19, 20))


def test_one_row_of_each_component_stays(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    near = text["a"] + " more"
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, "near"), (2, "b"), (3, "b"), (None, "c"), (None, "c"), (4, "d")]
    rows = [(k, (text | {"near": near})[t], "en", "s") for k, t in rows]
    got = partenum.keep_one_of_each(table(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, text["a"]), (2, text["b"]), (None, text["c"]), (4, text["d"])], key=str)
    unique = [(k, t, "en", "s") for k, t in ((5, text["a"]), (3, near), (9, text["b"]))]
    assert {r.doc_id for r in partenum.keep_one_of_each(table(spark, unique)).collect()} == {3, 9}


def test_pairs_leave_a_worker_some_at_a_time():
    n = 600
    ids = np.arange(n)
    args = ids, ids, np.full(n, 40), [bytes(8)] * n, Fraction(9, 10)
    parts = list(partenum.likely_links(*args, forest=False))
    assert max(map(len, parts)) <= 1 << 16
    assert {tuple(x) for part in parts for x in part.tolist()} == {(i, j) for j in range(n) for i in range(j)}
    pieces = [pa.RecordBatch.from_arrays([pa.array(part[:, k]) for k in range(2)], names=["a", "b"]) for part in parts] * 3
    joined = list(partenum._joined(iter(pieces)))
    assert sum(map(len, joined)) == 3 * n * (n - 1) // 2
    assert max(map(len, joined)) < 1 << 17


def test_components_need_no_round_once_edges_are_stars(spark, monkeypatch):
    written = []
    write = work.materialize
    monkeypatch.setattr(sys.modules[components.__module__], "materialize", lambda df, name: written.append(name) or write(df, name))

    def found(edges):
        written.clear()
        rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(rows) == len({r.node for r in rows})
        return {r.node: r.component for r in rows}

    assert found([(1, 5), (7, 1), (1, 7), (3, 9), (9, 9), (4, None)]) == {1: 1, 5: 1, 7: 1, 3: 3, 9: 3}
    assert len(written) == 1
    assert found([(4, None), (9, 9)]) == {}
    assert len(written) == 1
    # A chain, a ring, a hub that is not the least, and two hubs that share an end.
    edges = [(k, k + 1) for k in range(20)] + [(30 + k, 30 + (k + 1) % 7) for k in range(7)] + [(59, k) for k in range(50, 59)] + [(70, k) for k in range(71, 75)] + [(76, 74), (76, 77)]
    want = dict.fromkeys(range(21), 0) | dict.fromkeys(range(30, 37), 30) | dict.fromkeys(range(50, 60), 50) | dict.fromkeys([*range(70, 75), 76, 77], 70)
    assert found(edges) == want


def test_blocks_without_a_likely_link_give_no_rows(spark):
    apart = spark.createDataFrame([(7, k, k, 3) for k in (1, 2, 3)], "sig long, id long, c long, size long")
    bits = spark.createDataFrame([(k, 40, bytes([17 * k] * 8)) for k in (1, 2, 3)], "id long, n long, bits binary")
    for forest in (True, False):
        assert partenum._likely(apart, bits, Fraction(99, 100), forest).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(3, 300), st.sampled_from([Fraction(9, 10), Fraction(4, 5)]))
def test_similar_sets_share_a_signature(seed, n, similarity):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
    a = np.sort(pool[:n])
    drop = int(rng.integers(0, n // 4 + 1))
    b = np.sort(np.concatenate([a[drop:], pool[n : n + int(rng.integers(0, n // 4 + 1))]]))
    both = len(np.intersect1d(a, b))
    if Fraction(both, len(a) + len(b) - both) >= similarity and not np.array_equal(a, b):
        assert set(partenum.signatures(a, similarity)[0].tolist()) & set(partenum.signatures(b, similarity)[0].tolist())


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (7, 3), (200, 200)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_odd_rows_everywhere(spark, odd_rows):
    docs, n = table(spark, odd_rows), len(odd_rows)
    near = partenum.op3_near_duplicates(docs).collect()
    assert len(near) == n
    want = brute_components([r for r in odd_rows if r[0] is not None], 3, Fraction(9, 10))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near if r.doc_id is not None} == want
    assert mixing.op1_mix(docs).count() == n
    assert linededup.op4_line_dedup(docs).count() == n
    assert language.op7_language(docs).where("doc_id IN (30, 31, 32)").select("lang_pred").distinct().first()[0] == "und"
    assert lmscore.op6_score(docs).count() == n
    assert fingerprint.op5_fingerprint(docs).count() == n
    assert personal.op2_personal_data(docs).count() == n
    assert packing.op9_pack(docs).where("start = 0").count() == n


def test_empty_tables(spark):
    docs = table(spark, [])
    for op in (mixing.op1_mix, personal.op2_personal_data, partenum.op3_near_duplicates, linededup.op4_line_dedup, fingerprint.op5_fingerprint, lmscore.op6_score, language.op7_language, packing.op9_pack):
        assert op(docs).count() == 0, op


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 40, 200])), "en", rng.choice(["a", "b", "c", "d", None, "É"])) for i in range(900)] + [(900, "", "en", "zero"), (901, "w w", "en", "tiny")]
    docs = table(spark, rows)
    got = mixing.op1_mix(docs).collect()
    again = mixing.op1_mix(docs.repartition(7)).collect()
    assert sorted(got) == sorted(again)
    source = {r[0]: r[3] for r in rows}
    size = Counter()
    for d, t, _, s in rows:
        size[s] += len(WORD.findall(t))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = float(sum(size.values()))
    while True:  # reshare until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * size[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= above
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-9) and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]), (s, taken[s], target[s])


def test_repeated_rows_mix_as_other_rows_do(spark):
    rng = random.Random(5)
    texts = [" ".join(["w"] * rng.choice([2, 9, 30])) for _ in range(400)]
    single = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)]
    repeated = [(None if i % 3 else i // 20, t, lang, s) for i, t, lang, s in single]
    words = lambda rows: sum(len(r.text.split()) for r in rows if r.source == "a")
    want, got = (mixing.take_mix(table(spark, x)).collect() for x in (single, repeated))
    assert abs(words(want) - words(got)) <= 30
    assert mixing.take_mix(table(spark, [(1, None, "en", "a"), (2, "", "en", None), (3, "w w", "en", "b")])).count() <= 3


def test_line_dedup(spark):
    rows = []
    for k in range(12):
        rows.append((k, f"Only here {k} is this line.\n  The same footer line.  \nShort.\nThe same footer line.", "en", f"s{k}"))
    rows.append((50, "The eighth site is missing here.", "en", "s0"))
    got = {r.doc_id: (r.text, r.lines_removed) for r in linededup.op4_line_dedup(table(spark, rows)).collect()}
    assert got[0] == ("Only here 0 is this line.\n  The same footer line.  \nShort.", 1)
    assert got[5] == ("Only here 5 is this line.\nShort.", 2)
    assert got[50][1] == 0
    kept = linededup.keep_unrepeated_lines(table(spark, [*rows, *[(60 + k, "Nothing but what all repeat.", "en", f"s{k}") for k in range(9)]]))
    assert {r.doc_id for r in kept.collect()} == {*range(12), 50, 60} and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


@pytest.mark.parametrize("sites", [7, 8, 9, 40])
def test_sites_are_exact_near_the_threshold(spark, sites):
    rows = [(k, "Does this line stay or go?", "en", f"s{k % sites}") for k in range(80)]
    removed = sum(r.lines_removed for r in linededup.op4_line_dedup(table(spark, rows)).collect())
    assert removed == (79 if sites >= 8 else 0)


def test_scores(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    got = lmscore.op6_score(table(spark, rows)).collect()
    words = {d: WORD.findall(lower(t)) + [""] for d, t, *_ in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    count = Counter(w for d, *_ in rows if not held[d] for w in words[d])
    n, v = sum(count.values()), len(count)
    for r in got:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words[r.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words[r.doc_id]), sum(count[w] > 0 for w in words[r.doc_id]), n)
        assert r.score < 0


def segmentations(lattice, text):
    """All lists of arcs (log weight, pieces) that spell the text."""
    if not text:
        return [[]]
    out = []
    for j in range(1, min(len(text), lattice.longest) + 1):
        p = text[:j]
        if p in lattice.piece:
            arc = (lattice.weight[lattice.piece[p]], [lattice.piece[p]])
        elif j == 1:
            at = [lattice.byte[b] for b in p.encode()]
            arc = (lattice.weight[at].sum(), at)
        else:
            continue
        out += [[arc, *rest] for rest in segmentations(lattice, text[j:])]
    return out


@pytest.mark.parametrize("most_chars", [0, 64])
def test_lattice_sums_over_all_segmentations(monkeypatch, most_chars):
    monkeypatch.setattr(lmscore, "MOST_CHARS", most_chars)
    lattice = lmscore.Lattice()
    words_ = ["a", "the", "token", "xqzt", "naïve", "漢字", "\U0001f9ff", "aaaaaa", "don't"]
    counts = np.arange(1, len(words_) + 1)
    want, uses = [], np.zeros(len(lattice.weight))
    for w, c in zip(words_, counts, strict=True):
        ways = segmentations(lattice, "▁" + w)
        p = np.array([math.exp(sum(s for s, _ in way)) for way in ways])
        want.append(math.log(p.sum()))
        for way, share in zip(ways, p / p.sum(), strict=True):
            for _, at in way:
                for i in at:
                    uses[i] += c * share
    assert np.allclose(lattice.scores(words_), want)
    assert np.allclose(lattice.expected(words_, counts), uses)
    assert np.allclose([lattice.score(w) for w in words_], want)


def test_passes_raise_the_likelihood(spark):
    counts = [("token", 9), ("tokens", 4), ("zqx", 2), ("pretoken" * 9, 1)]
    weights = lmscore.fitted_weights(spark.createDataFrame(counts, "word string, c long"), 3)
    likelihood = lambda lattice: float(lattice.scores([w for w, _ in counts]) @ [c for _, c in counts])
    assert math.isclose(sum(map(math.exp, weights)), 1)
    assert likelihood(lmscore.Lattice(weights)) > likelihood(lmscore.Lattice())


def test_scores_are_marginals_without_a_floor(spark):
    texts = {2: "漢字" * 40, 3: "漢字" * 1500, 4: "aGk9/x" * 834, 5: "zq abc", 6: ""}
    rows = [(1, False, "a b abc abc")] + [(k, True, t) for k, t in texts.items()]
    got = {r.id: r.score for r in lmscore.score_documents(spark.createDataFrame(rows, "id long, held boolean, text string")).collect()}
    weights = lmscore.fitted_weights(spark.createDataFrame([("a", 1), ("b", 1), ("abc", 2)], "word string, c long"), 1)
    lattice = lmscore.Lattice(weights)

    def plain(word):
        text, out = "▁" + word, [0.0]
        for j in range(1, len(text) + 1):
            arcs = [out[i] + weights[lattice.piece[text[i:j]]] for i in range(max(0, j - lattice.longest), j) if text[i:j] in lattice.piece]
            if text[j - 1] not in lattice.piece:
                arcs.append(out[j - 1] + sum(weights[lattice.byte[b]] for b in text[j - 1].encode()))
            out.append(np.logaddexp.reduce(arcs))
        return out[-1]

    for k, t in texts.items():
        want = (sum(plain(lower(w)) for w in t.split()) + weights[lattice.end]) / math.log(10)
        assert math.isclose(got[k], want, rel_tol=1e-9), k
    assert got[4] < -2000


def test_fingerprints(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_A_BUCKET", 5)
    rows = sorted({r for r in odd_rows if r[0] is not None}, key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprint.op5_fingerprint(table(spark, rows)).collect()}
    prints = {}
    for (d, t, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, got[d].fingerprint) == got[d].fingerprint
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1
    assert 0.3 < got[35].near_edited < 0.7


def test_insertions_keep_most_chunks():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000))
    a, b, c = fingerprint.fingerprints(pa.array([text, text[:5000] + "INSERTED" + text[5000:], text[::-1]]))
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, b) > 0.95 and fingerprint.likeness(a, c) < 0.05


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in personal.EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in personal.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, personal.CARD, 14, 19), (3, personal.PHONE, 10, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or personal.luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", "1", "2", ".", "@x.y", "+", "-", " ", "555", "4111111111111111", "10.0.0.1", "é", "_", "(", "999.1.1.1"]), max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert personal.base_spans(text) == plain_base(text)


def test_field_finds_what_the_patterns_miss(spark):
    field = personal.fit_field()
    rng = random.Random(123)
    found = missed = extra = 0
    for _ in range(300):
        words, gold = personal._sentence(rng)
        got = set(field.best(words))
        found, missed, extra = found + len(got & gold), missed + len(gold - got), extra + len(got - gold)
    assert found / (found + missed) > 0.9 and found / (found + extra) > 0.9
    text = 'mail me at joe at example dot com or token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" and a.b@c.de'
    kinds = [(personal.KINDS[k], base) for _, k, _, base in personal.personal_spans(text, field)]
    assert ("email", True) in kinds and ("secret", False) in kinds
    clean = "The harbour was quiet in 1987, and version 2.0 of the plan cost 1,200 crowns at page 45."
    assert personal.personal_spans(clean, field) == []
    row = personal.op2_personal_data(table(spark, [(1, "é a@b.c 4111 1111 1111 1111", "en", "s")])).first()
    assert (row.n_email, row.n_card, row.base_sha256) == (1, 1, hashlib.sha256(b"email:2:7,card:8:27").hexdigest())


def test_segments_equal_all_segmentations():
    field = personal.fit_field()

    def every(n, at=0):
        if at == n:
            yield []
        else:
            yield from every(n, at + 1)
            for j in range(at + 1, min(n, at + personal.MOST_WORDS) + 1):
                for k in range(len(personal.KINDS)):
                    for rest in every(n, j):
                        yield [(at, j, k), *rest]

    rng = random.Random(3)
    for _ in range(12):
        words_ = personal._sentence(rng)[0][:4]
        worth = {(i, j + 1, k): s for j, row in enumerate(field._table(words_)) for i, _, own in row for k, s in enumerate(own)}
        total = lambda way: sum(worth[x] for x in way) if all(worth.get(x, -1) > personal.MARGIN for x in way) else -math.inf  # noqa: B023, E731
        assert math.isclose(total(field.best(words_)), max(map(total, every(len(words_)))), abs_tol=1e-9)


def test_long_runs_are_read_piece_by_piece(monkeypatch):
    field = personal.fit_field()
    rng = random.Random(9)
    words_ = [w for _ in range(60) for w in personal._sentence(rng)[0]]
    whole = field.best(words_)
    monkeypatch.setattr(personal, "FLUSH", 12)
    assert field.best(words_) == whole and len(whole) > 20
    text = " ".join(str(rng.randrange(10_000)) for _ in range(30_000))
    assert personal.field_spans(text, field) == [] or personal.field_spans(text, field)[-1][2] <= len(text)


def test_forms_that_the_field_never_saw():
    field = personal.fit_field()
    rng = random.Random(77)
    some = lambda cs, n: "".join(rng.choice(cs) for _ in range(n))
    digits, mixed = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    forms = [
        lambda: (4, "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)),
        lambda: (4, "ghp_" + some(mixed, 36)),
        lambda: (4, "sk-proj-" + some(mixed, 44)),
        lambda: (4, "glpat-" + some(mixed, 20)),
        lambda: (4, f"xoxb-{some(digits, 12)}-{some(mixed, 24)}"),
        lambda: (5, f"{rng.randint(100, 699)}-{some(digits, 2)}-{some(digits, 4)}"),
        lambda: (3, f"020 {some(digits, 4)} {some(digits, 4)}"),
        lambda: (6, "GB82WEST12345698765432"),
        lambda: (0, f"{some('abcdeil', 6)} AT {some('abcdeil', 7)} DOT org"),
    ]
    lead = {4: ["the key is", "use token:", "export API_KEY ="], 5: ["his ssn is", "ssn"], 3: ["call me at", "phone"], 6: ["pay to iban", "account"], 0: ["mail", "write to"]}
    found = total = 0
    for k in range(270):
        kind, what = forms[k % len(forms)]()
        before = "we were told that " + rng.choice(lead[kind]) + " "
        spans = personal.personal_spans(f"{before}{what} and no more than that", field)
        total += 1
        found += any(k2 == kind and a <= len(before) and b >= len(before) + len(what) for a, k2, b, _ in spans)
    assert found >= 0.9 * total
    clean = ["In 1987 they sold 1,200 boats at 45 crowns, 3 of 10 by June.", "See section 4.2.1 and figure 12 at page 310.", "Flight LH4711 leaves at 10:45 from gate B12.", "The a4 sheet is 210 by 297 mm; see https://example.com/a/12345.", "Run build_2024_final.py with python3.11 on x86_64.", "Order 2024-0017 shipped on 2024-05-06, 17 boxes."]
    assert sum(len(personal.personal_spans(t, field)) for t in clean) == 0


def test_language_holds_out(spark):
    rng = random.Random(6)
    parts = {"en": ["th", "er", "ing", "and"], "de": ["sch", "ung", "ei", "ver"], "fr": ["eau", "oi", "ment", "é"], "es": ["ción", "ado", "ll", "ñ"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang, "s") for k, lang in enumerate(rng.choice(list(parts)) for _ in range(300))]
    rows.append((900, "12 34 !?", "en", "s"))
    got = {r.doc_id: r for r in language.op7_language(table(spark, rows)).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang, _ in rows if d != 900) and got[900].lang_pred == "und"
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    kept = language.keep_identified(table(spark, rows))
    assert kept.count() == 300 and kept.columns == table(spark, []).columns


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'", "'ll", "'re", "é", "1", "²", ",", "\t", " '", "don't", " ", "漢", "🙂", "́", "'ve", "<|endoftext|>", " ", "א"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    got = []
    for c in chunks(pa.array(texts), 5000):
        ids, cut = tokenize.encoder().encode(c)
        got += [ids[a:b].tolist() for a, b in zip(cut, cut[1:])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_a_round_trip(spark, odd_rows, library):
    rows = [r for r in odd_rows if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    pieces = packing.pack_documents(table(spark, rows), length=64, tokens_a_bucket=3000).collect()
    for d, t, *_ in rows:
        ids, at = library.encode(t or "", add_special_tokens=False).ids + [1], 0
        for p in sorted((p for p in pieces if p.id == d), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : at], "<u4").tobytes())
        assert at == len(ids)
    sequences = {}
    for p in sorted(pieces, key=lambda p: p.offset):
        assert sequences.setdefault(p.sequence_id, 0) == p.offset
        sequences[p.sequence_id] += p.length
    assert all(n <= 64 and n & (n - 1) == 0 for n in sequences.values())


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_shingles_are_of_whole_words():
    texts = ["A b\tc\nd", "a B c d", "ab c d", "x", None, ""]
    sets = []
    for c in chunks(pa.array(texts), 8):
        hashes, first = word_hashes(c)
        sets += [shingles(hashes[a:b], 3).tolist() for a, b in zip(first, first[1:])]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and len(sets[2]) == len(sets[3]) == 1 and sets[4] == sets[5] == []
