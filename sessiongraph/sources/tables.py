"""Reading and writing tables: parquet folders or catalog tables in, parquet and JSON out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_ROWS = T.StructType(
    [
        T.StructField("exec_code", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)


def load(spark: SparkSession, location: str, name: str) -> DataFrame:
    """Table `name`: `<location>/<name>.parquet`, or a catalog table when `location` is a schema name.

    A location holding a `/` or a `:` is a folder, anything else a catalog schema.
    """
    if "/" in location or ":" in location:
        return spark.read.parquet(f"{location.rstrip('/')}/{name}.parquet")
    return spark.table(f"{location}.{name}")


def read_artifact(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table written by `write_artifact`; with a schema no file has to be opened for inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_artifact(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Overwrite `path` with `df` and return the path."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def write_model_rows(rows: DataFrame, path: str) -> str:
    """Write retrieval rows under their fixed schema; an empty result still leaves a readable table."""
    typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MODEL_ROWS])
    return write_artifact(typed, path)


def write_manifest(manifest: DataFrame, path: str) -> str:
    """Write a manifest, a table of one row per (section, split, metric), as JSON lines in one file."""
    manifest.coalesce(1).write.mode("overwrite").json(path)
    return path


def stack_metrics(*parts: DataFrame) -> DataFrame:
    """Union of long-form metric tables."""
    return reduce(DataFrame.unionByName, parts)


def to_long(row: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Turn the numeric columns of a narrow summary into (keys, metric, value) rows."""
    keys = keys or []
    names = [c for c in row.columns if c not in keys]
    cells = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    )
    return row.select(*keys, F.inline(cells))
