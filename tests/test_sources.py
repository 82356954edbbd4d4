import random

from pyspark.sql import functions as F

from tessella.operators import mutate
from tessella.sources import posts
from tessella.streaming import replies

DUMP = """<?xml version="1.0" encoding="utf-8"?>
<posts>
  <row Id="1" PostTypeId="1" Body="&lt;p&gt;q&lt;/p&gt;" Score="5" Title="T" Tags="&lt;java&gt;&lt;maven&gt;&lt;java&gt;" />
  <row Id="2" PostTypeId="2" Body="&lt;code&gt;int a;&lt;/code&gt;" Score="3" ParentId="1" />
  <row Id="3" PostTypeId="4" Body="" Score="x" />
</posts>"""


def test_dump(spark, tmp_path):
    (tmp_path / "posts.xml").write_text(DUMP)
    rows = posts.read_dump(spark, str(tmp_path / "posts.xml"))
    assert [(r.id, r.post_type, r.rating) for r in rows.orderBy("id").collect()] == [(1, "question", 5), (2, "answer", 3), (3, "unknown", None)]
    posts.write_posts(rows, str(tmp_path / "out"))
    q, a = spark.read.parquet(str(tmp_path / "out/questions")), spark.read.parquet(str(tmp_path / "out/answers"))
    assert q.first().tags == ["java", "maven"]
    assert posts.tagged_answers(a, q, ["maven", "java"]).count() == 1 and posts.tagged_answers(a, q, ["perl"]).count() == 0
    assert [tuple(r) for r in posts.fragments_of(a).collect()] == [(2, 0, "int a;")]


def test_code_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.py").write_text("x = 1\ny")
    (tmp_path / "a/b/Y.java").write_text("class Y {}")
    (tmp_path / "a/z.txt").write_text("no")
    rows = posts.read_code_files(spark, str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows) == ["Y.java", "x.py"]
    assert posts.read_code_files(spark, str(tmp_path), ("py",)).first().text == "x = 1\ny"


def test_feedback(spark, tmp_path):
    df = spark.createDataFrame([(1, "yes", "no", "c", "s", "java"), (2, "maybe", "no", "c", "s", "java")], posts.FEEDBACK_TYPE)
    for _ in range(2):
        posts.append_feedback(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2


def test_gather(spark):
    rows = [(1, "java", 1, 2, None), (1, "java", 1, 2, None), (2, "java", 1, 2, None), (3, "java", None, None, "boom"), (3, "java", 1, 1, None), (4, "java", 1, 1, None), (4, "perl", 1, 1, None)]
    df = spark.createDataFrame(rows, "query_id int, language string, number int, cluster_size int, error string")
    got = {r.query_id: (r.status, r.agree) for r in replies.gather(df).collect()}
    assert got == {1: ("finished", True), 2: ("pending", True), 3: ("exception", True), 4: ("finished", False)}
    asked = spark.createDataFrame([(1,), (9,)], "query_id int")
    assert {r.query_id: r.status for r in replies.reply_of(df, asked).collect()} == {1: "finished", 9: "nothing"}


def test_gather_stream(spark, tmp_path):
    rows = [(1, "java", 1, 2, None), (1, "java", 1, 2, None), (2, "java", 1, 2, None)]
    df = spark.createDataFrame(rows, "query_id int, language string, number int, cluster_size int, error string").withColumn("send_time", F.timestamp_seconds(F.lit(1000)))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = replies.gather_stream(stream).writeStream.format("memory").queryName("gathered").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.query_id: r.status for r in spark.table("gathered").collect()} == {1: "finished", 2: "pending"}


def test_replies_of_one_query_meet_across_hours_and_time_out(spark, tmp_path):
    kind = "query_id int, language string, number int, cluster_size int, error string, at long"
    batches = [[(1, "java", 1, 2, None, 3590), (2, "java", 1, 2, None, 3500)], [(1, "java", 1, 2, None, 3610)], [(3, "java", 2, 2, None, 90000)], [(3, "java", 0, 2, None, 90001)]]
    schema = None
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, kind).withColumn("send_time", F.timestamp_seconds("at")).drop("at").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        schema = df.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = replies.gather_stream(stream, late="1 hour", wait_seconds=600).writeStream.format("memory").queryName("met").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.query_id, r.status, r.number) for r in spark.table("met").collect()]
    assert (1, "finished", 2) in got and (3, "finished", 2) in got
    assert (2, "exception", 1) in got  # pending until the watermark passed its wait
    assert (1, "exception", 2) not in got


def test_search_stream(spark, tmp_path):
    from tessella.plans.search import prepare
    from tessella.settings import SearchSettings

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y")], "query_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    f = prepare(spark.createDataFrame([(7, "b c d e")], "frag_id int, text string"), "frag_id", "text", "frag_id")
    q = replies.search_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), f, SearchSettings(min_match=3, coverage=0.5), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(90)
    assert [(r.query_id, r.frag_id, r.coverage) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 7, 1.0)]


def test_messages(spark):
    df = spark.createDataFrame([('{"queryText": "a", "queryLanguage": "java", "queryId": 4}',), ("{no",)], "value string")
    good, bad = replies.decode(df)
    assert good.first().queryId == 4 and bad.count() == 1
    m = spark.range(1).select(replies.forward(replies.stamp(F.lit("x"), "me", "text"), "you").alias("m")).first().m
    assert m.header.sender == "me" and [f.sender for f in m.header.forwardedBy] == ["you"]


def test_mutations():
    rng, text = random.Random(1), "int a; b(a); c();"
    assert "a" not in mutate.names_of(mutate.replace_identifier(random.Random(3), "a = a + a", "python", "zz"), "python")
    assert len(mutate.remove_statement(rng, text, "java")) < len(text)
    assert sorted(mutate.swap_statements(rng, text, "java")) == sorted(text)
    assert mutate.swap_statements(rng, "a", "java") == "a" and mutate.insert_statement(rng, "", "java", ["x;"]) == "x;"


def test_survival(spark):
    from tessella.operators.analytics import survival
    from tessella.settings import SearchSettings

    f = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten eleven twelve")], "frag_id int, text string")
    presets = {"p": SearchSettings(min_match=2, coverage=0.3)}
    got = {r.step: r.fraction for r in survival(mutate.survival_curve(f, "words", mutate.replace_identifier, 2, presets)).collect()}
    assert set(got) == {1, 2} and got[1] == 1.0
