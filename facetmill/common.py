"""Tables in the shared folder, and sides that may be broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A small side is broadcast only after its rows were counted and found to be no more than this.
BROADCAST_ROWS = 100_000
#: Spark's own default number of shuffle partitions.
SPARKS_PARTITIONS = 200
#: Rows of a bucket of a catalog's largest table, so that what a task sorts and joins of it stays in memory; and buckets of a table.
BUCKET_ROWS, MOST_BUCKETS = 150_000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; on one machine (as in tests) one of our own will do."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="facetmill-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


#: Paths of this driver's intermediate tables, by application, and how often they were cleared.
_MADE: dict[str, list[str]] = {}
_CLEARED: dict[str, int] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete all intermediate tables of this application; returns how many.

    For when all results were written: tables that were returned and not yet read may rest on them.
    """
    key = spark.sparkContext.applicationId
    paths, _CLEARED[key] = _MADE.pop(key, []), _CLEARED.get(key, 0) + 1
    for path in paths:
        remove(spark, path)
    return len(paths)


def era(spark: SparkSession) -> tuple[str, int]:
    """What tells apart the times between which intermediate tables were cleared: part of a key of what is kept."""
    key = spark.sparkContext.applicationId
    return key, _CLEARED.get(key, 0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession, rows: int = 0) -> int:
    """As many as shuffle partitions; where these were left at Spark's default, twice the cores if that is less.

    With ``rows``, of the largest table, no fewer than one for every ``BUCKET_ROWS``: buckets keep their size as a catalog grows.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(n, max(2, 2 * spark.sparkContext.defaultParallelism)) if n == SPARKS_PARTITIONS else n
    return max(n, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def clustered(df: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Write a table to the shared folder in buckets of ``keys`` (by default ``bucket_count``) and read it back.

    Groups and joins by these keys, and inside ``co_located`` by more columns than these, then need no
    shuffle. All rows of a key are read by one task, so keys must be of bounded size.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    n = buckets or bucket_count(spark)
    table = "facetmill_" + re.sub(r"\W", "_", path.rpartition("/")[2])
    df.repartition(n, *keys).write.option("path", path).bucketBy(n, *keys).format("parquet").saveAsTable(table)
    return spark.table(table)


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """For actions inside: sides in equal buckets of some of the join's columns are not shuffled by all of them.

    Nor does a side go through the driver, unless it was marked for it: several at once are more than it holds.
    """
    held = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def in_place(df: DataFrame, name: str) -> DataFrame:
    """``stored``, with sides in equal buckets of some of a join's columns joined where they lie."""
    with co_located(df.sparkSession):
        return stored(df, name)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a side for broadcast if its counted rows fit; else leave the join to shuffle it."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows, if it is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)
