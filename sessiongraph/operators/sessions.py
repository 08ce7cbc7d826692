"""Cutting views into sessions and assigning whole sessions to time splits."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessiongraph.functions import scans
from sessiongraph.functions.times import seconds_between
from sessiongraph.session import materialize, shuffle_partitions

# The scan travels with the plan, so the executors need no copy of this package.
cloudpickle.register_pickle_by_value(scans)

# Fixed value: seconds without a view after which a session ends.
DEFAULT_TIMEOUT = 1800


def sessionize(views: DataFrame, timeout: int = DEFAULT_TIMEOUT, partitions: int | None = None) -> DataFrame:
    """Number each user's sessions from 1; a gap of more than `timeout` whole seconds starts a new one.

    Returns (user_id, session_id, item_id, emitted, session_start), one row per view.

    One segmented scan for all users alike. Views are sorted by user and time over ranges, so a user with very many
    views lies in several partitions; the stage that sorts them cuts the sessions of each stretch of a user within a
    partition, and stores the rows. Only the first and the last user of a partition can go on in another one: their
    stretches, at most two per partition, are summarized to four values and chained, and rows of such a stretch get
    the number and the start that they continue. A view without a time opens no session.
    """
    n = partitions or shuffle_partitions(views.sparkSession)
    rows = views.select("user_id", "item_id", "emitted")
    order = ["user_id", "emitted", "item_id"]
    stamp = rows.schema["emitted"].dataType.simpleString()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    cut = materialize(
        rows.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(scans.sessions(timeout), f"{schema}, part int, opened long, opened_at {stamp}, first_at {stamp}"),
        "cut_sessions",
    )
    carried = materialize(_carried(cut, timeout), "carried_sessions")
    same = F.col("user_id").eqNullSafe(F.col("of_user")) & (F.col("part") == F.col("of_part"))
    return cut.join(F.broadcast(carried), same, "left").select(
        "user_id",
        (F.col("opened") + F.coalesce("base", F.lit(1))).cast("long").alias("session_id"),
        "item_id",
        "emitted",
        F.coalesce("opened_at", "carried_start", "first_at").alias("session_start"),
    )


def _carried(cut: DataFrame, timeout: int) -> DataFrame:
    """(of_user, of_part, base, carried_start) of the users that go on in another partition, two per partition at most:
    the number and the start of the session that their first view there belongs to."""
    ends = cut.groupBy("part").agg(
        F.min(F.struct("user_id")).alias("low"), F.max(F.struct("user_id")).alias("high")
    )
    ends = ends.select("part", F.explode(F.array("low", "high")).alias("end")).select("part", "end.user_id").distinct()
    ends = ends.select(F.col("part").alias("of_part"), F.col("user_id").alias("of_user"))
    same = F.col("user_id").eqNullSafe(F.col("of_user")) & (F.col("part") == F.col("of_part"))
    stretches = (
        cut.join(F.broadcast(ends), same)
        .groupBy("of_user", "of_part")
        .agg(
            F.min("emitted").alias("first_at"),
            F.max("emitted").alias("last_at"),
            F.max("opened").alias("opened_inside"),
            F.max("opened_at").alias("last_opened_at"),
        )
    )
    by_user = Window.partitionBy("of_user").orderBy("of_part")
    so_far = by_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = by_user.rowsBetween(Window.unboundedPreceding, -1)
    gap = seconds_between(F.col("first_at"), F.last("last_at", ignorenulls=True).over(earlier))
    begins = F.row_number().over(by_user) == 1
    opens_first = F.when(begins, True).otherwise(F.coalesce(gap > timeout, F.lit(False)))
    last_start = F.coalesce("last_opened_at", F.when(F.col("opens_first"), F.col("first_at")))
    return (
        stretches.withColumn("opens_first", opens_first)
        .withColumn("total", F.sum(F.col("opened_inside") + F.col("opens_first").cast("long")).over(so_far))
        .withColumn("last_start", last_start)
        .withColumn("previous_start", F.last("last_start", ignorenulls=True).over(earlier))
        .select(
            "of_user",
            "of_part",
            (F.col("total") - F.col("opened_inside")).alias("base"),
            F.when(F.col("opens_first"), F.col("first_at")).otherwise(F.col("previous_start")).alias("carried_start"),
        )
    )


def split_by_time(session_views: DataFrame, cutoff_train: str, cutoff_val: str) -> DataFrame:
    """Add `split` from the session start, so all views of a session fall on one side."""
    start = F.col("session_start")
    return session_views.withColumn(
        "split",
        F.when(start < F.lit(cutoff_train).cast("timestamp_ntz"), "train")
        .when(start < F.lit(cutoff_val).cast("timestamp_ntz"), "val")
        .otherwise("test"),
    )


def cutoffs(
    start: str, end: str, train_days_before_end: int = 30, val_days_before_end: int = 15
) -> tuple[str, str]:
    """Train and val cutoffs counted back from the end of the window; all four dates must be in order."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    train = last - timedelta(days=train_days_before_end)
    val = last - timedelta(days=val_days_before_end)
    if not first < train < val < last:
        raise ValueError(f"dates out of order: {first}, {train}, {val}, {last}")
    return train.isoformat(), val.isoformat()
