"""Tables that cut lineage, kept in the folder that the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable

__all__ = ["bucket_of", "collect_garbage", "discard", "materialize", "new_path", "range_edges", "reachable", "shared_dir", "with_least"]

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Without one, only a master in this process gets a folder of its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc._jsc.sc().getCheckpointDir().get()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file:///tmp/tessella-{sc.applicationId}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below shared_dir, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


@contextmanager
def _spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends; its table is all that later ones read."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet and read it back: any lost executor can read it again."""
    path = new_path(df.sparkSession, name)
    with _spent_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_least(df: DataFrame, keys: list[str], value: str, name: str, slices: int = 64) -> DataFrame:
    """df with the least value of each group of non-null keys.

    Groups are dealt over slices by the value's hash: a group of any size is no single task's, and
    what is joined back has one row for each key and slice that occur.
    """
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(value), F.lit(slices)).cast("int"))
    part = cut.groupBy(*keys, "_slice").agg(F.min(value).alias("_least"))
    whole = part.groupBy(*keys).agg(F.min("_least").alias(name))
    return cut.join(part.drop("_least").join(whole, keys), [*keys, "_slice"]).drop("_slice")


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads, and let the driver forget their plans."""
    if tables:
        collect_garbage(tables[0].sparkSession)
    for df in tables:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(f)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def collect_garbage(spark: SparkSession) -> None:
    """After many jobs: what their plans held on the driver, and the broadcasts that Spark's cleaner finds unused, go."""
    spark._jvm.System.gc()


def bucket_of(key: Column, edges: list[int]) -> Column:
    """The number of edges below the key, by a balanced tree of comparisons."""
    def tree(low: int, high: int):
        if low == high:
            return F.lit(low).cast("long")
        mid = (low + high) // 2
        return F.when(key <= edges[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(edges))


def range_edges(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Keys that cut df into about equal ranges: buckets - 1 numbers at most."""
    if buckets <= 1:
        return []
    marks = [k / buckets for k in range(1, buckets)]
    return sorted(set(df.agg(F.percentile_approx(key, marks, max(10_000, 20 * buckets))).first()[0] or []))
