"""Matching of recommendation logs and views that arrive as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.sources.behavior import MATCH_TOLERANCE_SECONDS, PRODUCT_PAGE, reconcile

# How much later than the newest row of its stream a row may come.
LATENESS = "10 minutes"


def match_streams(
    logs: DataFrame,
    view_events: DataFrame,
    identity: DataFrame,
    page_type: str = PRODUCT_PAGE,
    tolerance_seconds: int = MATCH_TOLERANCE_SECONDS,
    lateness: str = LATENESS,
) -> DataFrame:
    """Every (log, view) pair of one item, cookie and account at most `tolerance_seconds` apart, one row per pair.

    An inner join of two streams. Both sides have a watermark, and times of a pair lie close together, so a row stays in
    the state only until the other stream has passed it by the tolerance and `lateness`. Rows that come later than that
    are left out; rows without a time, key, user or item match nothing. `identity` is a plain table.
    """
    log_side = logs.where(F.col("page_type") == page_type).select(
        "execution_id",
        "log_instant",
        F.col("log_instant").cast("timestamp").alias("log_at"),
        "account_id",
        "item_id",
        "cookie",
    )
    view_side = view_events.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull()).select(
        F.col("account_id").alias("view_account"),
        F.col("item_id").alias("view_item"),
        F.col("cookie").alias("view_cookie"),
        "user_id",
        "emitted",
        F.col("emitted").cast("timestamp").alias("seen_at"),
    )
    reach = F.expr(f"interval {int(tolerance_seconds)} seconds")
    pairs = log_side.withWatermark("log_at", lateness).join(
        view_side.withWatermark("seen_at", lateness),
        (F.col("account_id") == F.col("view_account"))
        & (F.col("item_id") == F.col("view_item"))
        & (F.col("cookie") == F.col("view_cookie"))
        & (F.col("seen_at") >= F.col("log_at") - reach)
        & (F.col("seen_at") <= F.col("log_at") + reach),
    )
    return reconcile(
        pairs.select("execution_id", "log_instant", "account_id", "item_id", "user_id", "emitted"), identity
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append to the parquet table at `path` what follows from all input that has arrived, and stop; a later run with
    the same `checkpoint` goes on from there."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
