"""Questions and answers: from XML dumps to tables, and reads of those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import element_texts, node_texts

ROW_TYPE = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in ("Id", "PostTypeId", "Body", "Score", "Title", "Tags", "ParentId")])


def parse_tags(tags: Column) -> Column:
    """`<a><b>` to an array of distinct tags in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(tags, F.lit("<([^>]*)>"), F.lit(1)))


def number(value: Column, *, strict: bool = False, default: int | None = None) -> Column:
    """An attribute as a number; strict raises on bad ones, else they are the default."""
    got = value.cast("long") if strict else value.try_cast("long")
    return got if default is None else F.coalesce(got, F.lit(default))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a dump as (id, post_type, body, rating, title, tags, parent)."""
    raw = spark.read.format("xml").option("rowTag", "row").schema(ROW_TYPE).load(path)
    kind = F.when(F.col("_PostTypeId") == "1", "question").when(F.col("_PostTypeId") == "2", "answer").otherwise("unknown")
    return raw.select(number(F.col("_Id")).alias("id"), kind.alias("post_type"), F.coalesce("_Body", F.lit("")).alias("body"), number(F.col("_Score")).cast("int").alias("rating"), F.col("_Title").alias("title"), parse_tags(F.col("_Tags")).alias("tags"), number(F.col("_ParentId")).alias("parent"))


def questions_of(posts: DataFrame) -> DataFrame:
    return posts.where("post_type = 'question'").select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "body", "title", "rating")


def answers_of(posts: DataFrame) -> DataFrame:
    return posts.where("post_type = 'answer'").select("id", "body", "rating", "parent")


def write_posts(posts: DataFrame, folder: str) -> None:
    """Both tables, replaced."""
    questions_of(posts).write.mode("overwrite").parquet(f"{folder}/questions")
    answers_of(posts).write.mode("overwrite").parquet(f"{folder}/answers")


def write_jdbc(posts: DataFrame, url: str, properties: dict[str, str], batch: int = 500) -> None:
    """Both tables into a database, batch rows an insert."""
    for name, df in (("questions", questions_of(posts)), ("answers", answers_of(posts))):
        df.write.option("batchsize", batch).jdbc(url, name, mode="overwrite", properties=properties)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], low: int, high: int, parts: int, batch: int = 250) -> DataFrame:
    """A table by ranges of its key."""
    return spark.read.jdbc(url, table, column="id", lowerBound=low, upperBound=high, numPartitions=parts, properties={**properties, "fetchsize": str(batch)})


def tagged_answers(answers: DataFrame, questions: DataFrame, tags: list[str]) -> DataFrame:
    """Answers whose question has all the tags."""
    want = F.array(*map(F.lit, tags)).cast("array<string>")
    q = questions.where(F.size(F.array_except(want, F.col("tags"))) == 0).select(F.col("id").alias("parent"))
    return answers.join(q, "parent", "left_semi")


def some_answers(answers: DataFrame, n: int, seed: int | None = 0, after: int = 0) -> DataFrame:
    """n answers in a seeded random order; without a seed those with the least ids above `after`."""
    if seed is None:
        return answers.where(F.col("id") > after).orderBy("id").limit(n)
    return answers.orderBy(F.rand(seed), "id").limit(n)


def in_shard(id_: Column, digits: list[int]) -> Column:
    return F.pmod(id_, F.lit(10)).isin(list(digits))


def fragments_of(answers: DataFrame, *, element: str = "code", nodes: bool = False) -> DataFrame:
    """(answer_id, frag_ord, text): one row for each code element, or for each node below one."""
    texts = node_texts(F.col("body"), element) if nodes else element_texts(F.col("body"), element)
    return answers.select(F.col("id").alias("answer_id"), F.posexplode(texts).alias("frag_ord", "text"))


def longest_code(posts: DataFrame) -> DataFrame:
    """(id, rating, code_length): rating is null for unknown posts, length where there is no code."""
    longest = F.array_max(F.transform(element_texts(F.col("body")), F.length))
    return posts.select("id", F.when(F.col("post_type") != "unknown", F.col("rating")).alias("rating"), longest.alias("code_length"))


def root_tags(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(answer_id, parent, tags) of each answer's question."""
    return answers.select(F.col("id").alias("answer_id"), "parent").join(questions.select(F.col("id").alias("parent"), "tags"), "parent").select("answer_id", "parent", "tags")


def tag_bridge(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tags(tag_id, tag) numbered by name, and question_tags(question_id, tag_id).

    Names are few against questions; their numbering is one sort of distinct names.
    """
    from pyspark.sql import Window

    pairs = questions.select(F.col("id").alias("question_id"), F.explode("tags").alias("tag"))
    tags = pairs.select("tag").distinct().withColumn("tag_id", F.row_number().over(Window.orderBy("tag")).cast("long"))
    return tags.select("tag_id", "tag"), pairs.join(tags, "tag").select("question_id", "tag_id")


API_ITEMS = "struct<items:array<struct<question_id:bigint,answer_id:bigint,body:string,title:string,score:int,tags:array<string>>>,page:int,page_size:int,total:bigint,has_more:boolean,backoff:int,type:string,error_id:int,error_message:string>"


def parse_api(reply: Column) -> Column:
    """A reply of a question-and-answer service; bad JSON gives null fields."""
    return F.from_json(reply, API_ITEMS)


def read_code_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("java", "py", "hs")) -> DataFrame:
    """(path, text) of all files with these endings, in all folders below."""
    glob = "*." + ("{" + ",".join(extensions) + "}" if len(extensions) > 1 else extensions[0])
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


FEEDBACK_TYPE = "query_id long, similar string, reuse string, comment string, source string, language string"


def append_feedback(feedback: DataFrame, path: str) -> None:
    """Rows whose answers are yes, no or neutral, with the time of writing."""
    ok = feedback.where(F.col("similar").isin("yes", "no", "neutral") & F.col("reuse").isin("yes", "no", "neutral"))
    ok.withColumn("time", F.current_timestamp()).write.mode("append").parquet(path)
