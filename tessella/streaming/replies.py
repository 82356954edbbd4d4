"""Continuous queries: intake, search by micro-batch, and gathering of partial replies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.aggregate import status
from ..plans.search import prepare, search
from ..settings import SearchSettings

QUERY_TYPE = "struct<queryText:string,queryLanguage:string,queryId:bigint,querySettings:struct<minMatchLength:int,levenshteinDistance:int,coveragePercentage:double,blockFiltering:boolean,semanticThreshold:double,minSumResultLength:int>>"
REPLY_TYPE = "struct<query_id:bigint,language:string,number:int,cluster_size:int,error:string,results:array<string>,send_time:timestamp>"


def decode(messages: DataFrame, kind: str = QUERY_TYPE, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad): messages that parse, as their fields, and the texts of those that don't."""
    parsed = messages.withColumn("m", F.from_json(F.col(value).cast("string"), kind))
    good = F.coalesce(F.col("m.queryText" if "queryText" in kind else "m.query_id").isNotNull(), F.lit(False))
    return parsed.where(good).select("m.*"), parsed.where(~good).select(F.col(value).cast("string").alias("value"))


def stamp(content: Column, sender: str, content_type: str) -> Column:
    """A message: header and content."""
    header = F.struct(F.current_timestamp().alias("sendTime"), F.lit(sender).alias("sender"), F.lit(content_type).alias("contentType"), F.array().cast("array<struct<sender:string,time:timestamp>>").alias("forwardedBy"))
    return F.struct(header.alias("header"), content.alias("content"))


def forward(message: Column, by: str) -> Column:
    """The message with one more forwarder in its trail."""
    trail = F.array_append(message["header"]["forwardedBy"], F.struct(F.lit(by).alias("sender"), F.current_timestamp().alias("time")))
    return message.withField("header", message["header"].withField("forwardedBy", trail))


def route(queries: DataFrame, language: str) -> DataFrame:
    return queries.where(F.col("queryLanguage") == language)


def search_stream(queries: DataFrame, fragments: DataFrame, settings: SearchSettings, sink: str, checkpoint: str, *, language: str = "words", trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of (query_id, text) is one search; its matches go to Parquet under the batch's number.

    The checkpoint's offsets are the acknowledgement; a batch that is repeated replaces its output.
    """

    def run(batch: DataFrame, number: int) -> None:
        got = search(prepare(batch, "query_id", "text", "query_id", language), fragments, settings, language=language)
        got.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def gather(replies: DataFrame) -> DataFrame:
    """State of each query: merged partial replies; an error outweighs them, before or after."""
    per = replies.groupBy("query_id").agg(F.sum(F.when(F.col("error").isNull(), F.col("number"))).alias("number"), F.max("cluster_size").alias("cluster_size"), F.max("error").alias("error"), F.count("*").alias("n_replies"), F.max("language").alias("language"), (F.min("language") == F.max("language")).alias("agree"))
    return per.withColumn("status", status(F.col("number"), F.col("cluster_size"), F.col("error")))


GATHERED = "query_id long, number long, cluster_size long, error string, n_replies long, status string"


def _gathered(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, wait_ms: int) -> Iterator[pd.DataFrame]:
    number, size, error, n, until = state.get if state.exists else (None, None, None, 0, 0)
    if state.hasTimedOut:
        state.remove()
        if error is None and (number is None or size is None or number < size):
            yield pd.DataFrame({"query_id": [key[0]], "number": [number], "cluster_size": [size], "error": ["timed out"], "n_replies": [n], "status": ["exception"]}).astype({"number": "Int64", "cluster_size": "Int64"})
        return
    for frame in frames:
        n += len(frame)
        errors, sizes = frame["error"].dropna(), frame["cluster_size"].dropna()
        parts = frame.loc[frame["error"].isna(), "number"].dropna()
        error = max([*errors, *([] if error is None else [error])], default=None)
        size = max([*map(int, sizes), *([] if size is None else [size])], default=None)
        number = number if parts.empty else int(parts.sum()) + (number or 0)
        until = max(until, int(frame["send_time"].max().timestamp() * 1000))
    state.update((number, size, error, n, until))
    state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs()) + wait_ms)
    status_ = "exception" if error is not None else "nothing" if number is None else "finished" if size is not None and number >= size else "pending"
    yield pd.DataFrame({"query_id": [key[0]], "number": [number], "cluster_size": [size], "error": [error], "n_replies": [n], "status": [status_]}).astype({"number": "Int64", "cluster_size": "Int64"})


def gather_stream(replies: DataFrame, *, late: str = "1 hour", wait_seconds: int = 300) -> DataFrame:
    """gather over a stream (query_id, number, cluster_size, error, send_time), in update mode.

    State is kept by query id, so partial replies meet however far apart they are sent; it goes
    wait_seconds of event time after the last reply, when what is still pending becomes an exception.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _gathered(key, frames, state, wait_seconds * 1000)

    rows = replies.select("query_id", F.col("number").cast("long").alias("number"), F.col("cluster_size").cast("long").alias("cluster_size"), "error", "send_time").withWatermark("send_time", late)
    kept = "number long, cluster_size long, error string, n_replies long, until long"
    return rows.groupBy("query_id").applyInPandasWithState(run, GATHERED, kept, "update", GroupStateTimeout.EventTimeTimeout)


def reply_of(replies: DataFrame, query_ids: DataFrame) -> DataFrame:
    """Status of asked ids; those without a reply are `nothing`."""
    got = gather(replies)
    return query_ids.join(got, "query_id", "left").withColumn("status", F.coalesce("status", F.lit("nothing")))


def with_timeout(replies: DataFrame, now: Column, limit: str = "INTERVAL 5 MINUTES") -> DataFrame:
    """Queries that are pending for longer than the limit become exceptions."""
    late = (F.col("status") == "pending") & (F.col("sent") < now - F.expr(limit))
    return replies.withColumn("status", F.when(late, "exception").otherwise(F.col("status"))).withColumn("error", F.when(late, "timed out").otherwise(F.col("error")))


def counters(messages: DataFrame, kind: str = "kind") -> DataFrame:
    """Requests and replies so far."""
    return messages.groupBy(kind).agg(F.count("*").alias("n"))
