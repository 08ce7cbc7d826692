from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from sessiongraph.operators.sessions import cutoffs, sessionize, split_by_time
from sessiongraph.sources.behavior import attach_sessions, match_logs_to_views, reconcile

T0 = datetime(2024, 1, 1)
VIEW = "user_id long, item_id long, emitted timestamp_ntz"


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def brute(views, timeout):
    out = []
    for user in {v[0] for v in views}:
        mine = sorted((v for v in views if v[0] == user), key=lambda v: (v[2], v[1]))
        number, start, last = 0, None, None
        for _, item, when in mine:
            if last is None or int((when - last).total_seconds()) > timeout:
                number, start = number + 1, when
            out.append((user, number, item, when, start))
            last = when
    return sorted(out)


def test_gap_is_cut_to_whole_seconds(spark):
    views = [(1, 10, at(0)), (1, 11, at(1800)), (1, 12, at(3600.5)), (1, 13, at(5401.6))]
    found = sessionize(spark.createDataFrame(views, VIEW), 1800)
    assert [r[:3] for r in rows(found)] == [(1, 1, 10), (1, 1, 11), (1, 1, 12), (1, 2, 13)]


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_users_get_the_same_sessions(spark, seed):
    rng = random.Random(seed)
    views = [
        (user, rng.randrange(5), at(round(rng.uniform(0, 40_000), 1)))
        for user, n in ((1, 400), (2, 30), (3, 1))
        for _ in range(n)
    ]
    views += views[:50]
    df = spark.createDataFrame(views, VIEW)
    wanted = brute(views, 300)
    assert rows(sessionize(df, 300)) == wanted
    for partitions in (1, 16, 90):
        assert rows(sessionize(df, 300, partitions=partitions)) == wanted


def test_one_read_and_no_counting_pass(spark):
    df = spark.createDataFrame([(1, 10, at(0)), (1, 11, at(5))], VIEW)
    plan = sessionize(df, 300)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1


def test_views_without_user_or_time(spark):
    views = [(None, 1, at(0)), (None, 2, at(4000)), (2, 3, None), (2, 4, at(10)), (2, 5, at(9000)), (3, 6, None)]
    for partitions in (1, 8):
        found = sessionize(spark.createDataFrame(views, VIEW), 1800, partitions=partitions)
        assert rows(found, "user_id", "session_id", "item_id", "session_start") == sorted(
            [
                (None, 1, 1, at(0)), (None, 2, 2, at(4000)), (2, 1, 3, None),
                (2, 1, 4, at(10)), (2, 2, 5, at(9000)), (3, 1, 6, None),
            ],
            key=lambda r: tuple((v is not None, v) for v in r),
        )
    assert sessionize(spark.createDataFrame([], VIEW), 1800).count() == 0


def test_split_follows_session_start(spark):
    start = [(datetime(2024, 1, 20, 23, 59),), (datetime(2024, 1, 21),), (datetime(2024, 1, 26),)]
    df = spark.createDataFrame(start, "session_start timestamp_ntz")
    assert [r[1] for r in rows(split_by_time(df, "2024-01-21", "2024-01-26"))] == ["train", "val", "test"]


def test_cutoffs():
    assert cutoffs("2026-01-01", "2026-05-01") == ("2026-04-01", "2026-04-16")
    with pytest.raises(ValueError):
        cutoffs("2026-04-10", "2026-05-01")
    with pytest.raises(ValueError):
        cutoffs("2026-01-01", "2026-05-01", 10, 20)


def test_reconcile(spark):
    views = spark.createDataFrame([(1, 5), (2, 5)], "user_id long, item_id long")
    identity = spark.createDataFrame([(1, 7)], "source_id long, master_id long")
    assert rows(reconcile(views, identity), "user_id", "item_id") == [(2, 5), (7, 5)]


def test_match_keeps_all_pairs_within_three_seconds(spark):
    offsets = [-3.0, -3.000001, 0, 3.0, 3.000001, 59.9]
    views = [("a", 7, 1, 1, at(600 + o)) for o in offsets] + [("a", 7, 1, 1, at(600)), ("b", 7, 1, 1, at(600))]
    events = spark.createDataFrame(
        views, "account_id string, item_id long, user_id long, cookie long, emitted timestamp_ntz"
    )
    logs = spark.createDataFrame(
        [(1, at(600), "a", 7, 1, "PRODUCT"), (2, at(600), "a", 7, 1, "SEARCH")],
        "execution_id long, log_instant timestamp_ntz, account_id string, item_id long, cookie long,"
        " page_type string",
    )
    identity = spark.createDataFrame([], "source_id long, master_id long")
    wanted = [(1, at(597), 1), (1, at(600), 2), (1, at(603), 1)]
    for width in (1, 3, 60):
        found = match_logs_to_views(logs, events, identity, bucket_seconds=width)
        assert rows(found, "execution_id", "emitted", "copies") == wanted


def test_attached_sessions_count_copies(spark):
    matched = spark.createDataFrame(
        [(1, at(0), "a", 7, 1, at(0), 2)],
        "execution_id long, log_instant timestamp_ntz, account_id string, item_id long, user_id long,"
        " emitted timestamp_ntz, copies long",
    )
    views = spark.createDataFrame(
        [(1, 3, 7, at(0), "val")] * 2,
        "user_id long, session_id long, item_id long, emitted timestamp_ntz, split string",
    )
    assert rows(attach_sessions(matched, views), "session_id", "split", "copies") == [(3, "val", 4)]
