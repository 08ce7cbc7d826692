"""Tables that are written beside their place, checked there, and put in place only if they hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sessiongraph.operators.quality import schema_drift

REPORT = "source string, drifted_columns bigint, rows_before bigint, rows_after bigint, published boolean"


def move_into_place(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; what was at `target` is deleted first."""
    files = spark._jvm.org.apache.hadoop.fs
    old, new = files.Path(source), files.Path(target)
    system = new.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(new.getParent())
    system.delete(new, True)
    if not system.rename(old, new):
        raise OSError(f"could not move {source} to {target}")


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def publish(df: DataFrame, path: str, expected: T.StructType, name: str = "table") -> DataFrame:
    """Write `df` to `path` if it has the `expected` columns before the write and the same rows after it.

    One row (source, drifted_columns, rows_before, rows_after, published). A table whose columns differ is not
    written at all (`rows_after` is null). Others go to a folder beside `path`, are read back and compared in
    columns and number of rows; only then they replace what is at `path`. Readers never see a table that failed.
    """
    spark = df.sparkSession
    before = df.count()
    drift = len(schema_drift(df, expected))
    after = None
    if not drift:
        staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        read = spark.read.parquet(staged)
        drift, after = len(schema_drift(read, expected)), read.count()
        if not drift and after == before:
            move_into_place(spark, staged, path)
            return spark.createDataFrame([(name, 0, before, after, True)], REPORT)
        delete_folder(spark, staged)
    return spark.createDataFrame([(name, drift, before, after, False)], REPORT)
