"""Column helpers for time arithmetic that work for both timestamp types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds from `earlier` to `later`, the fraction cut off."""
    return (later - earlier).cast("long")


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds since 1970 of a timestamp column, the fraction cut off."""
    without_zone = isinstance(df.schema[column].dataType, T.TimestampNTZType)
    origin = F.expr("timestamp_ntz'1970-01-01 00:00:00'" if without_zone else "timestamp'1970-01-01 00:00:00'")
    return seconds_between(F.col(column), origin)


def within_days(column: str, start: str | None, end: str | None) -> Column:
    """Half-open date window: `start` belongs to it, the whole `end` day does not."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        condition = condition & (F.col(column) < F.lit(end).cast("timestamp_ntz"))
    return condition
