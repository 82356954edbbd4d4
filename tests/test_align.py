import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import aggregate, align, blocks, cluster
from tessella.plans.search import prepare, search
from tessella.settings import PRESETS, SearchSettings, read_service_settings


def brute_force(q, f, k):
    """Maximal runs by extending from every pair of starts."""
    out = set()
    for i in range(len(q)):
        for j in range(len(f)):
            if i and j and q[i - 1] == f[j - 1]:
                continue
            n = 0
            while i + n < len(q) and j + n < len(f) and q[i + n] == f[j + n]:
                n += 1
            if n >= k:
                out.add((i, i + n, j, j + n))
    return out


def sequences(seed, n):
    rng = random.Random(seed)
    return [(i, [rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 8, 25, 40]))]) for i in range(n)]


def frames(spark, queries, fragments):
    return spark.createDataFrame(queries, "query_id int, tokens array<string>"), spark.createDataFrame(fragments, "frag_id int, tokens array<string>")


def test_exact_matches_equal_brute_force(spark):
    queries, fragments = sequences(1, 8), sequences(2, 8)
    q, f = frames(spark, queries, fragments)
    for k in (1, 2, 5):
        got = {(r.query_id, r.frag_id, r.q_start, r.q_end, r.f_start, r.f_end) for r in align.exact_matches(q, f, k).collect()}
        assert got == {(a, b, *m) for a, s in queries for b, t in fragments for m in brute_force(s, t, k)}


def test_subsumption_equals_brute_force(spark):
    queries, fragments = sequences(3, 6), sequences(4, 6)
    q, f = frames(spark, queries, fragments)
    found = [tuple(r) for r in align.exact_matches(q, f, 2).collect()]

    def inside(a, b):
        return a != b and a[:2] == b[:2] and b[2] <= a[2] and a[3] <= b[3] and b[4] <= a[4] and a[5] <= b[5] and b[6] <= a[6]

    want = {a for a in found if not any(inside(a, b) for b in found)}
    doubled = spark.createDataFrame(found + found, "query_id int, frag_id int, q_start int, q_end int, f_start int, f_end int, dist int")
    got = [tuple(r) for r in aggregate.remove_subsumed(doubled).collect()]
    assert len(got) == len(want) and set(got) == want


def test_null_and_empty_documents_match_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d")], "id int, text string")
    q, f = prepare(docs, "id", "text", "query_id"), prepare(docs, "id", "text", "frag_id")
    rows = search(q, f, SearchSettings(min_match=2, coverage=0.0)).collect()
    assert [(r.query_id, r.frag_id, r.q_end) for r in rows] == [(3, 3, 4)]
    assert search(q.limit(0), f, PRESETS["high"]).count() == 0


def test_distance_finds_what_exact_search_misses(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, a), (2, a.replace("six", "SIX!x"))], "id int, text string")
    q, f = prepare(docs.where("id = 1"), "id", "text", "query_id"), prepare(docs.where("id = 2"), "id", "text", "frag_id")
    assert search(q, f, SearchSettings(min_match=10, coverage=0.0)).count() == 0
    rows = search(q, f, SearchSettings(min_match=10, distance=2, coverage=0.0)).collect()
    assert [(r.q_start, r.q_end) for r in rows] == [(0, 12)] and 0 < rows[0].dist <= 2


def fuzzy_brute_force(q, f, k, most):
    """Largest of all pairs of ranges that start and end on equal tokens, by whole edit distances."""
    near = {}
    for a in range(len(q)):
        for c in range(len(f)):
            if q[a] != f[c]:
                continue
            row = list(range(len(f) - c + 1))
            for b in range(a + 1, len(q) + 1):
                row, last = [b - a], row
                for d in range(c + 1, len(f) + 1):
                    same = q[b - 1] == f[d - 1]
                    row.append(min(last[d - c] + 1, row[-1] + 1, last[d - c - 1] + (not same)))
                    if same and row[-1] <= most and b - a >= k:
                        near[a, b, c, d] = row[-1]
    inside = lambda x, y: x != y and y[0] <= x[0] and x[1] <= y[1] and y[2] <= x[2] and x[3] <= y[3]
    return {(*x, e) for x, e in near.items() if not any(inside(x, y) for y in near)}


def test_fuzzy_matches_equal_brute_force(spark):
    rng = random.Random(9)
    text = lambda: [rng.choice("abc") for _ in range(rng.randint(0, 16))]
    queries, fragments = [(i, text()) for i in range(12)], [(i, text()) for i in range(12)]
    for _, t in queries[:6]:  # few edits apart
        copy = list(t)
        for _ in range(2):
            at = rng.randint(0, len(copy))
            del copy[at : at + 1]
            copy.insert(rng.randint(0, len(copy)), rng.choice("abc"))
        fragments.append((len(fragments), copy))
    q, f = frames(spark, queries, fragments)
    for k, most in ((2, 3), (5, 1), (6, 2), (8, 3)):
        got = [tuple(r) for r in align.fuzzy_matches(q, f, k, most).collect()]
        want = {(a, b, m[0], m[1], m[2], m[3], m[4]) for a, s in queries for b, t in fragments for m in fuzzy_brute_force(s, t, k, most)}
        assert len(got) == len(set(got)) and set(got) == want, (k, most)


def test_edits_cost_their_distance(spark):
    w = [f"w{i}" for i in range(60)]
    close = w[:18] + ["X", *w[18:21], "Y"] + w[21:39]  # two edits, three equal tokens between them
    parts = w[:4] + ["X"] + w[5:11] + ["Y"] + w[12:20]  # runs of 4, 6 and 8
    again = w[20:26] + ["n0"] + w[:10] + ["X"] + w[11:25]  # a run on another diagonal first
    q, f = frames(spark, [(1, w[:18] + ["x", *w[18:21], "y"] + w[21:39]), (2, w[:20]), (3, w[:25])], [(1, close), (2, parts), (3, again)])
    got = {tuple(r) for r in align.fuzzy_matches(q, f, 20, 2).collect()}
    assert {(1, 1, 0, 41, 0, 41, 2), (2, 2, 0, 20, 0, 20, 2), (3, 3, 0, 25, 7, 32, 1)} <= got


def test_fuzzy_words_equal_all_pairs(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "w string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for most in (0, 1, 2):
        got = {(r.query, r.word): r.dist for r in align.fuzzy_words(df, df, most, q="w", w="w").collect()}
        want = {(a, b): d for a in words for b in words if (d := distance(a, b)) <= most and (a or most)}
        assert {k: v for k, v in got.items() if k[0]} == {k: v for k, v in want.items() if k[0]}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 8), st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7))))
def test_cliques_equal_all_subsets(n, edges):
    nodes = list(range(n))
    edges = {e for e in edges if max(e, default=0) < n}
    assert blocks.maximal_cliques(nodes, edges) == blocks.cliques_brute_force(nodes, edges)


def test_small_graph():
    edges = {(0, 1), (0, 4), (1, 2), (3, 2), (4, 1), (4, 3), (5, 3)}
    assert blocks.maximal_cliques(list(range(6)), edges) == [[0, 1, 4], [1, 2], [2, 3], [3, 4], [3, 5]]


def test_relation_of_blocks(spark):
    code = [("a { b } { c }", 2, 5, (1, 1)), ("a { b } c d", 0, 4, (0, 0)), ("a { b { c", 0, 4, (2, 0)), ("a", 0, 0, (0, 0))]
    for text, a, b, want in code:
        kinds = F.split(F.lit(text), " ")
        r = spark.range(1).select(blocks.relation(blocks.delimiters(kinds, "{", "}"), F.lit(a), F.lit(b), F.size(kinds)).alias("r")).first().r
        assert (r.up, r.down) == want, text


def test_strong_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (6, 7)], "a int, b int")
    got = {r.node: (r.cluster_id, r.cluster_size) for r in cluster.strong_components(nodes, edges).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (3, 2), 4: (3, 2), 5: (5, 1), 6: (6, 1), 7: (7, 1)}


def test_settings():
    s = PRESETS["high"]
    assert SearchSettings.from_json(s.to_json()) == s
    assert read_service_settings("language: java\ndigits: [1, 2]\n").digits == (1, 2)
    assert read_service_settings('{"language": "java", "digits": [3]}').language == "java"
    try:
        read_service_settings("language: java\ndigits: []\n")
    except ValueError:
        return
    raise AssertionError


def test_second_hash_is_not_a_function_of_the_first(spark):
    df = spark.range(50).selectExpr("id", "transform(sequence(0, 9), i -> string(id * 31 + i)) AS tokens")
    g = align.shingles(df, "id", 3).withColumn("folded", F.xxhash64(F.col("h1"), F.lit(1)))
    seeded = align.shingles(df, "id", 3)
    assert seeded.where("h1 = h2").count() == 0
    # A literal behind the gram would be hashed with h1 as its seed.
    gram = F.expr("xxhash64(slice(tokens, pos + 1, 3), 1)")
    assert g.join(df, "id").where(F.col("h2") == gram).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_subsumption_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        q, f, n, m = rng.randrange(120), rng.randrange(60), rng.choice([1, 2, 2, 3, 9, 70]), rng.choice([0, 0, 1])
        rows.append((rng.randrange(2), 0, q, q + n, f, f + n + m, m))
    names = ["query_id", "frag_id", "q_start", "q_end", "f_start", "f_end", "dist"]
    distinct = set(rows)
    held = lambda b, a: a != b and a[:2] == b[:2] and b[2] <= a[2] and a[3] <= b[3] and b[4] <= a[4] and a[5] <= b[5] and b[6] <= a[6]
    want = {a for a in distinct if not any(held(b, a) for b in distinct)}
    got = [tuple(r[c] for c in names) for r in aggregate.remove_subsumed(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_matches_do_not_depend_on_the_join(spark, monkeypatch, most):
    monkeypatch.setattr(align, "few_grams", lambda df, k: most > 0)
    rng = random.Random(4)
    rows = [(i, [rng.choice("abc") for _ in range(25)]) for i in range(8)]
    q, f = spark.createDataFrame(rows[:4], "query_id int, tokens array<string>"), spark.createDataFrame(rows[4:], "frag_id int, tokens array<string>")
    got = {(r.query_id, r.frag_id, r.q_start, r.f_start, r.q_end - r.q_start) for r in align.exact_matches(q, f, 3).collect()}
    want = set()
    for i, a in rows[:4]:
        for j, b in rows[4:]:
            for x in range(25):
                for y in range(25):
                    if a[x] == b[y] and (x == 0 or y == 0 or a[x - 1] != b[y - 1]):
                        n = 0
                        while x + n < 25 and y + n < 25 and a[x + n] == b[y + n]:
                            n += 1
                        if n >= 3:
                            want.add((i, j, x, y, n))
    assert got == want


def test_repeats_meet_a_fragment_once(spark):
    q = spark.createDataFrame([(1, list("ab") + ["x"] * 12)], "query_id int, tokens array<string>")
    f = spark.createDataFrame([(2, ["x"] * 6)], "frag_id int, tokens array<string>")
    assert align.exact_matches(q, f, 2).count() > align.exact_matches(q, f, 2, no_repeats=True).count() > 0


def test_semantic_search_computes_its_matches_once(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y z"), (None, "a b c d e f g")], "id long, text string")
    q, f = prepare(texts, "id", "text", "query_id"), prepare(texts.where("id is not null"), "id", "text", "frag_id")
    found = search(q, f, SearchSettings(min_match=3, coverage=0.5, semantic=0.4))
    assert sorted((r.query_id, r.frag_id, r.q_start, r.q_end, r.coverage, round(r.sim, 9)) for r in found.collect()) == [(1, 1, 0, 7, 1.0, 1.0), (2, 2, 0, 3, 1.0, 1.0)]
    # One for the words and one for the result; they share a shuffle.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti") == 2


def test_semantic_search_with_edits_reads_the_words_of_queries(spark):
    q = prepare(spark.createDataFrame([(1, "a b c X d e f")], "id long, text string"), "id", "text", "query_id")
    f = prepare(spark.createDataFrame([(7, "a b c Y d e f"), (8, "u v w")], "id long, text string"), "id", "text", "frag_id")
    (row,) = search(q, f, SearchSettings(min_match=6, distance=1, coverage=0.5, semantic=0.1)).collect()
    # Six words of one document in two weigh w each; the query's own word is in none and weighs more.
    w, x = math.log(3 / 2), math.log(3)
    assert (row.dist, row.q_start, row.q_end) == (1, 0, 7)
    assert row.sim == pytest.approx(6 * w * w / math.sqrt((6 * w * w + x * x) * (7 * w * w)))


def test_coverage_is_the_union_whatever_the_order_of_ties(spark):
    rows = [(1, 1, a, b) for a, b in [(0, 4), (0, 4), (2, 6), (6, 7), (8, 9), (8, 9), (3, 5)]] + [(None, 1, 0, 9)]
    m, f = spark.createDataFrame(rows, "query_id int, frag_id int, f_start int, f_end int"), spark.createDataFrame([(1, 10)], "frag_id int, n_tokens int")
    assert {(r.query_id, r.coverage) for r in aggregate.min_coverage(m, f, 0.5).collect()} == {(1, 0.8)}
    assert aggregate.min_coverage(m, f, 0.81).count() == 0
