from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import html as H
from tessella.functions import lexers as L
from tessella.functions import ranges as R
from tessella.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def kinds(tokens):
    return [k for k, _, _ in tokens]


def test_identifier_words(spark):
    cases = {"runTest": ["run", "test"], "run_test_stuff": ["run", "test", "stuff"], "testHTTPConnection": ["test", "http", "connection"], "testNew_HTTPConnection": ["test", "new", "http", "connection"], "testHTTP": ["test", "htt"], "HTTP2": ["http"], "x": [], "a_b": []}
    for name, want in cases.items():
        assert one(spark, T.identifier_words(F.lit(name))) == want, name


def test_java():
    assert kinds(L.java_tokens("a && b")) == ["identifier", "&", "&", "identifier"]
    assert kinds(L.java_tokens("x <= 0x1f")) == ["identifier", "<", "=", "number"]
    assert kinds(L.java_tokens("throws if_x if (a) 1.5f")) == ["identifier", "condition", "identifier", "condition", "(", "identifier", ")", "number"]
    assert kinds(L.java_tokens('import a.b; /* c */ int x = "a\\"b"; // end')) == ["primitive", "identifier", "=", "string", ";"]
    assert kinds(L.java_tokens("a ^ b")) == ["identifier"]
    assert kinds(L.java_tokens("loop: @Override true")) == ["label", "annotation", "boolean"]
    text = "int a; for (i) { b(); c(); } d();"
    assert [text[a:b] for a, b in L.java_statements(text)][-1] == "d();"


def test_python():
    assert kinds(L.python_tokens("note = index\n")) == ["not", "identifier", "=", "in", "identifier"]
    assert kinds(L.python_tokens("if a:\n  b\nc")) == ["if", "identifier", ":", "indent", "identifier", "unindent", "identifier"]
    assert kinds(L.python_tokens("f(a,\n   b)\n")) == ["identifier", "(", "identifier", ",", "identifier", ")"]
    assert kinds(L.python_tokens("a \\\n  + 1")) == ["identifier", "+", "number"]
    assert L.python_tokens("a ? b") is None
    assert kinds(L.python_tokens("'''a\n'b'''")) == ["string"]
    text = "if a:\n  b\nc\nd"
    assert [text[a:b] for a, b in L.python_statements(text)] == ["  b\n", "c\n"]


def test_haskell():
    assert kinds(L.haskell_tokens("f x = Data.Map.map x >>= g -- c\n")) == ["identifier", "identifier", "=", "identifier", "identifier", ">>=", "identifier"]
    assert kinds(L.haskell_tokens("let x :: Int; y")) == ["let", "identifier", "::", "type"]
    assert L.haskell_tokens(";") is None
    assert kinds(L.haskell_tokens("{-# A #-} {- b -} where")) == ["pragma", "where"]


def test_tokenize_column(spark):
    df = spark.createDataFrame([("a = b",), (None,), ("a ? b",)], "t string")
    rows = [r.x for r in df.select(L.tokenize(F.col("t"), "python").alias("x")).collect()]
    assert [(t.kind, t.start, t.end) for t in rows[0]] == [("identifier", 0, 1), ("=", 2, 3), ("identifier", 4, 5)]
    assert rows[1:] == [None, None]


def test_html(spark):
    page = "<p>x</p><pre><code>a &lt; b<br>c</code></pre><code class='q'><b>d</b>e</code>"
    assert one(spark, H.element_texts(F.lit(page))) == ["a < b\nc", "de"]
    assert one(spark, H.node_texts(F.lit(page)))[0].startswith("a < b")


def test_cover(spark):
    want = [(0, 15)]
    for order in ([(0, 5), (4, 11), (10, 15)], [(10, 15), (0, 5), (4, 11)], [(4, 11), (10, 15), (0, 5)]):
        column = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in order])
        assert [tuple(r) for r in one(spark, R.cover_array(column))] == want
        rows = spark.createDataFrame([(1, a, b) for a, b in order], "k int, start int, end int")
        assert [tuple(r)[1:] for r in R.cover_rows(rows, ["k"]).collect()] == want


def test_empty_ranges(spark):
    lit = lambda *xs: [F.lit(x) for x in xs]
    assert one(spark, R.overlaps(*lit(3, 3, 0, 5))) and not one(spark, R.overlaps(*lit(3, 3, 3, 3)))
    assert tuple(one(spark, R.merged(*lit(0, 5, 5, 9)))) == (0, 9) and one(spark, R.merged(*lit(0, 5, 6, 9))) is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(0, 6)), min_size=1, max_size=6))
def test_cover_has_the_points_of_its_ranges(spark, pairs):
    ranges = [(a, a + n) for a, n in pairs]
    column = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ranges])
    got = [tuple(r) for r in one(spark, R.cover_array(column))]
    assert {p for a, b in got for p in range(a, b)} == {p for a, b in ranges for p in range(a, b)}
    assert all(x[1] < y[0] for x, y in zip(got, got[1:]))


def test_text_edits(spark):
    t = F.lit("héllo")
    assert one(spark, T.insert_at(t, F.lit(2), F.lit("--"))) == "hé--llo"
    assert one(spark, T.replace_range(t, F.lit(1), F.lit(3), F.lit("a"))) == "halo"
    assert one(spark, T.indent_to(F.lit("  a\n    b\n"), F.lit(1))) == " a\n   b\n"
    assert one(spark, T.with_gutter(F.lit("a\nb"))) == "1 a\n2 b"
    assert one(spark, R.numbered_lines(F.lit("ab\ncd"), F.lit(1), F.lit(4)))[0].text == ".b"
