"""Views, recommendation logs and the match between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongraph.functions.times import epoch_seconds, within_days

# Fixed values of the log source.
PRODUCT_PAGE = "PRODUCT"
MATCH_TOLERANCE_SECONDS = 3


def reconcile(rows: DataFrame, identity: DataFrame) -> DataFrame:
    """Replace `user_id` by the master id where the identity map (source_id, master_id) knows it.

    A left join on the user: adaptive skew handling splits the left side when one user is hot. The map
    must have one master per source (`operators.quality.conflicting_values` checks that).
    """
    known = identity.select(F.col("source_id").alias("user_id"), "master_id")
    return (
        rows.join(known, "user_id", "left")
        .withColumn("user_id", F.coalesce("master_id", "user_id"))
        .drop("master_id")
    )


def _usable_views(
    view_events: DataFrame, accounts: DataFrame | None, start: str | None, end: str | None
) -> DataFrame:
    rows = view_events.where(
        within_days("emitted", start, end) & F.col("user_id").isNotNull() & F.col("item_id").isNotNull()
    )
    if accounts is not None:
        rows = rows.join(accounts.select("account_id").distinct(), "account_id", "left_semi")
    return rows


def resolve_views(
    view_events: DataFrame,
    identity: DataFrame,
    accounts: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """(emitted, item_id, user_id), one row per view by a known visitor of a known master item."""
    rows = _usable_views(view_events, accounts, start, end).select("emitted", "item_id", "user_id")
    return reconcile(rows, identity)


def keep_catalog_items(views: DataFrame, items: DataFrame) -> DataFrame:
    """Views of catalog items only. Applied before sessions are cut, so it moves session boundaries."""
    return views.join(items.select("item_id").distinct(), "item_id", "left_semi")


def match_logs_to_views(
    logs: DataFrame,
    view_events: DataFrame,
    identity: DataFrame,
    accounts: DataFrame | None = None,
    publishers: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    page_type: str = PRODUCT_PAGE,
    tolerance_seconds: int = MATCH_TOLERANCE_SECONDS,
    bucket_seconds: int = 60,
) -> DataFrame:
    """Every (log, view) pair of one item, cookie and account at most `tolerance_seconds` apart.

    Views alike in item, cookie, account, user and time are counted before the shuffle; `copies` says
    how many plain-join rows an output row stands for.

    The equi-join key carries a time bucket, so a cookie or item that holds a large share of the rows
    is spread over its buckets. A log takes part in each bucket its tolerance window touches: one
    bucket in most cases, two near an edge. Log payloads stay out of this join; fetch them afterwards
    by `execution_id`.
    """

    def bucket(seconds: Column) -> Column:
        return F.floor(seconds / F.lit(bucket_seconds))

    wanted = logs.where((F.col("page_type") == page_type) & within_days("log_instant", start, end))
    if publishers is not None:
        wanted = wanted.join(publishers.select("publisher_id").distinct(), "publisher_id", "left_semi")
    reach = F.make_dt_interval(secs=F.lit(tolerance_seconds))
    at = epoch_seconds(wanted, "log_instant")
    log_side = wanted.select(
        "execution_id",
        "log_instant",
        "account_id",
        "item_id",
        "cookie",
        F.explode(
            F.sequence(bucket(at - F.lit(tolerance_seconds)), bucket(at + F.lit(tolerance_seconds)))
        ).alias("bucket"),
    )
    seen = _usable_views(view_events, accounts, start, end)
    view_side = seen.groupBy(
        "account_id",
        "item_id",
        "cookie",
        "user_id",
        "emitted",
        bucket(epoch_seconds(seen, "emitted")).alias("bucket"),
    ).agg(F.count("*").alias("copies"))
    close = F.col("emitted").between(F.col("log_instant") - reach, F.col("log_instant") + reach)
    pairs = (
        log_side.join(view_side, ["account_id", "item_id", "cookie", "bucket"])
        .where(close)
        .select("execution_id", "log_instant", "account_id", "item_id", "user_id", "emitted", "copies")
    )
    return reconcile(pairs, identity)


def attach_sessions(matched: DataFrame, session_views: DataFrame) -> DataFrame:
    """Session and split of each matched log, by item, time and user.

    Repeated views of one (item, time, user) belong to one session, so both sides are reduced to
    distinct rows first. `copies` multiplies up to the number of rows the plain join would give.
    """
    keys = ["item_id", "emitted", "user_id"]
    views = session_views.groupBy(*keys, "session_id", "split").agg(F.count("*").alias("view_copies"))
    logs = matched.groupBy("execution_id", "log_instant", "account_id", *keys).agg(
        F.sum("copies").alias("log_copies")
    )
    return (
        logs.join(views, keys)
        .withColumn("copies", F.col("log_copies") * F.col("view_copies"))
        .drop("log_copies", "view_copies")
    )
