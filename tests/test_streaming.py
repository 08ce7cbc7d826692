from __future__ import annotations

from datetime import datetime, timedelta

from conftest import rows

from sessiongraph.session import new_path
from sessiongraph.sources.behavior import match_logs_to_views
from sessiongraph.streaming.matches import match_streams, run_available

T0 = datetime(2024, 1, 1)
LOG = "execution_id string, log_instant timestamp_ntz, account_id long, item_id long, cookie string, page_type string"
VIEW = "account_id long, item_id long, cookie string, user_id long, emitted timestamp_ntz"
COLUMNS = ("execution_id", "user_id", "emitted")


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def test_pairs_over_two_runs_and_late_rows(spark):
    logs = [
        [("e1", at(0), 1, 10, "c", "PRODUCT"), ("e2", at(100), 1, 10, "c", "PRODUCT"), ("e3", at(100), 1, 10, "c", "HOME"),
         ("e4", at(100), 1, 10, None, "PRODUCT")],
        [("e5", at(5_000), 1, 11, "d", "PRODUCT")],
        [("late", at(100), 1, 10, "c", "PRODUCT"), ("e6", at(9_000), 1, 11, "d", "PRODUCT")],
    ]
    views = [
        [(1, 10, "c", 7, at(3)), (1, 10, "c", 7, at(3)), (1, 10, "c", 7, at(3.5)), (1, 10, "c", None, at(1))],
        # A view that belongs to a log of the first run.
        [(1, 10, "c", 8, at(97)), (1, 11, "d", 7, at(5_002)), (1, 11, "e", 7, at(5_002))],
        [(1, 11, "d", 9, at(9_000))],
    ]
    identity = spark.createDataFrame([(8, 80)], "source_id long, master_id long")
    log_path, view_path = new_path(spark, "logs"), new_path(spark, "views")
    out, state = new_path(spark, "pairs"), new_path(spark, "state")
    seen = []
    for log_rows, view_rows in zip(logs, views, strict=True):
        spark.createDataFrame(log_rows, LOG).coalesce(1).write.mode("append").parquet(log_path)
        spark.createDataFrame(view_rows, VIEW).coalesce(1).write.mode("append").parquet(view_path)
        found = match_streams(
            spark.readStream.schema(LOG).parquet(log_path), spark.readStream.schema(VIEW).parquet(view_path), identity
        )
        run_available(found, out, state)
        seen.append(rows(spark.read.schema(found.schema).parquet(out), *COLUMNS))
    assert seen[0] == [("e1", 7, at(3))] * 2
    assert seen[1] == [("e1", 7, at(3))] * 2 + [("e2", 80, at(97)), ("e5", 7, at(5_002))]
    # The watermark has passed the late log; in a batch it would match.
    assert seen[2] == seen[1] + [("e6", 9, at(9_000))]
    batch = match_logs_to_views(spark.read.schema(LOG).parquet(log_path), spark.read.schema(VIEW).parquet(view_path), identity)
    assert {r[0] for r in rows(batch, *COLUMNS)} == {"e1", "e2", "e5", "e6", "late"}


def test_empty_streams(spark):
    log_path, view_path = new_path(spark, "logs"), new_path(spark, "views")
    spark.createDataFrame([], LOG).write.parquet(log_path)
    spark.createDataFrame([], VIEW).write.parquet(view_path)
    identity = spark.createDataFrame([], "source_id long, master_id long")
    found = match_streams(
        spark.readStream.schema(LOG).parquet(log_path), spark.readStream.schema(VIEW).parquet(view_path), identity
    )
    out = new_path(spark, "pairs")
    run_available(found, out, new_path(spark, "state"))
    assert spark.read.schema(found.schema).parquet(out).count() == 0
