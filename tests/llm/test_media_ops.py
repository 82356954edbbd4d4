"""Web archives, audio and the pipeline."""

import hashlib
import io
import wave

import numpy as np
import pytest

from tessella.llm import chroma, warc
from tessella.llm.work import new_path

PAGES = "page_id long, url string, html string, record string, kind string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], PAGES)


def test_archives_round_trip(spark):
    big = "é" * 700
    rows = [(1, "u", "x" * 3000), (2, "u\n", "x" * 3000), (5, None, big), (7, "v", big), (None, "z", "x" * 3000), (9, "w", None), (10, "w", "a" * 999), (11, "w", "a" * 999), (12, "b", "ab\r\n\r\n" * 100_000), (12, "b", "ab\r\n\r\n" * 100_000)]
    got = [tuple(r)[:5] for r in warc.op8_archive(pages(spark, rows)).collect()]
    heads = {"x" * 3000: 2, big: 7}
    want = []
    for p, _, html in rows:
        body = (html or "").encode()
        head = heads.get(html)
        again = head is not None and head != p
        want.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", head if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_chunks_are_bounded_and_whole(spark):
    body = "".join(f"line {k}\n" for k in range(40_000))
    records = warc.page_records(pages(spark, [(1, "u", body), (2, "v", "")]))
    folder = new_path(spark, "test")
    back = warc.read_archives(warc.write_archives(warc.payload_chunks(records, chunk=1000), folder), folder, chunk=5000)
    rows = sorted(back.where("record = '1'").collect(), key=lambda r: r.chunk_no)
    assert max(len(r.data) for r in rows) <= 5000 and b"".join(bytes(r.data) for r in rows) == body.encode()
    assert rows[-1].last and rows[-1].sha1 == hashlib.sha1(body.encode()).hexdigest() == rows[-1].digest
    assert rows[3].sha1 == hashlib.sha1(b"".join(bytes(r.data) for r in rows[:4])).hexdigest()


def test_no_pages(spark):
    assert warc.op8_archive(pages(spark, [])).count() == 0


def wav(samples, rate=chroma.RATE):
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes((samples * 20_000).astype("<i2").tobytes())
    return held.getvalue()


def tune(seed, n=60):
    rng = np.random.default_rng(seed)
    t = np.arange(700) / chroma.RATE
    return np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (k / 12) * t) for k in rng.integers(0, 36, n)])


def test_recordings_align(spark):
    a, b = tune(1), tune(2)
    noise = np.random.default_rng(3).normal(0, 0.05, len(a))
    rows = [(100, wav(a)), (1, wav(a + noise)), (2, wav(a[chroma.HOP * 10 :])), (3, wav(b)), (4, wav(a)), (5, None), (6, b"no wave"), (7, wav(a[:100])), (8, wav(np.zeros(40_000)))]
    prints = chroma.audio_fingerprints(spark.createDataFrame(rows, "id long, audio binary"), "id")
    links = {(r.q, r.r): (r.offset, r.bit_error) for r in chroma.align(prints, prints["id"] % 100 == 0).collect()}
    assert links[4, 4] == (0, 0.0)  # 4 and 100 are one class
    assert links[4, 1][0] == 0 and links[4, 1][1] < 0.2
    assert links[4, 2][0] == -10 and links[4, 2][1] < 0.1
    assert set(links) == {(4, 4), (4, 1), (4, 2)}


def test_offset_votes_equal_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.repeat(rng.integers(0, 4, 12), rng.integers(1, 6, 12))[: rng.integers(1, 40)].astype(np.int32) for _ in range(2))
        want = [sum(a[i] == b[i + o] for i in range(len(a)) if 0 <= i + o < len(b)) for o in range(1 - len(a), len(b))]
        assert chroma.offset_votes(a, b).tolist() == want


def test_sustained_tones_and_short_overlaps_align(spark):
    rng = np.random.default_rng(6)
    noise = lambda n: rng.integers(-(2**31), 2**31, n).tolist()
    tone, same = [77] * 50, noise(18)
    rows = [(100, tone), (1, noise(300) + [77] * 100 + noise(50))]
    # The overlap of most votes is too short; the error at the offset of most votes is too large.
    rows += [(200, [5] * 12 + same), (2, same[:9] + [x ^ 1 for x in same[9:]] + noise(30) + [5] * 12)]
    rows += [(300, [3] * 12 + noise(88)), (3, noise(100))]
    far, near = rows[-1][1], rows[-2][1]
    far[60:72] = [3] * 12  # 12 votes at 60 amid 28 others; 11 at -84, where the rest agrees as well
    far[:16] = near[84:95] + [x ^ 1 for x in near[95:]]
    prints = spark.createDataFrame(rows, "id long, frames array<int>")
    links = {(r.q, r.r): (r.offset, r.bit_error) for r in chroma.align(prints, prints["id"] % 100 == 0).where("q <> r").collect()}
    assert links[100, 1] == (300, 0.0)  # of 300 to 350, all with 50 votes
    assert links[200, 2][0] == -12 and links[300, 3][0] == -84
    assert set(links) == {(100, 1), (200, 2), (300, 3)}


def test_unreadable_audio_has_no_frames():
    assert len(chroma.fingerprint(None)) == len(chroma.fingerprint(b"x")) == len(chroma.fingerprint(wav(np.zeros(10)))) == 0


def test_op10(spark):
    rng = np.random.default_rng(5)
    v = [rng.normal(0, 0.12, 64).tolist() for _ in range(3)]
    rows = [(0, v[0], 1), (1, v[0], 1), (2, v[1], 1), (100, v[2], 1), (7, None, None), (8, [], 1), (None, v[1], 2)]
    got = {r.vec_id: r for r in chroma.op10_chroma(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == 7 and got[1].class_id == 0 and got[1].best_query == 0 and got[100].n_links == 1
    assert got[2].n_links == 0 and got[7].n_frames == 0 and got[8].n_frames == 0
    assert chroma.op10_chroma(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = np.random.default_rng(7)
    parts = {"en": ["th", "er", "ing"], "fr": ["eau", "oi", "ment"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(n))
    rows = [(k, text("en" if k % 2 else "fr", 80), "en" if k % 2 else "fr", f"s{k % 9}") for k in range(90)]
    rows += [(100 + k, rows[0][1], "fr", f"s{k % 3}") for k in range(5)]
    rows += [(110 + k, rows[1][1] + f" more{k}", "en", f"s{k % 3}") for k in range(3)]
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, "123 !!", "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], schema)
    alive = set(range(90)) | set(range(100, 105)) | {110, 111, 112}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name in ("language_id", "line_dedup"):
            assert ids == alive
        elif name == "near_duplicates":
            assert ids == set(range(90))
        else:
            assert ids <= set(range(90)) and docs.count() > 45
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in pieces.collect()} == ids
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op4_line_dedup", "op8_archive"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from tessella.llm import queries

    folder = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(map(str, (tuple(r) for r in got.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))
