"""Spark session settings shared by the jobs, the tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows of narrow tables that one task sorts or hashes.
ROWS_PER_TASK = 500_000
# Spark's setting for deleting the shuffle files of a query when it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "sessiongraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on; `conf` keys use `__` for dots.

    Partition counts are left to the cluster's own settings.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: `spark.checkpoint.dir`, which all machines can reach.

    A temporary folder is used only on a local master with no such setting: on a cluster the other
    machines could not read it, so a missing setting is an error there.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sessiongraph-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path among the application's intermediate tables that nothing has used yet."""
    return f"{_tables_folder(spark)}/{uuid.uuid4().hex}/{name}"


def _tables_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written.

    DataFrames that still read them fail afterwards; other applications' tables stay.
    """
    _delete(spark, _tables_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside go when the query ends, and not when the driver collects its garbage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def materialize(df: DataFrame, name: str = "table", lean: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Later plans start at a columnar scan with known size instead of the whole lineage, and a lost
    executor costs no recomputation. `lean` is for large tables: it takes more time to compress them, and
    the shuffle files of the write are deleted when it ends.
    """
    return _stored(df, new_path(df.sparkSession, name), lean)


def _stored(df: DataFrame, path: str, lean: bool) -> DataFrame:
    if lean:
        with released_shuffles(df.sparkSession):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_table(df: DataFrame, name: str = "table") -> Iterator[DataFrame]:
    """A lean table that only queries inside read; it is deleted after them."""
    path = new_path(df.sparkSession, name)
    try:
        yield _stored(df, path, lean=True)
    finally:
        _delete(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Shuffle partitions for so many rows: their number grows with the rows, so that a task's share does not."""
    return max(shuffle_partitions(spark), -(-rows // rows_per_task))
