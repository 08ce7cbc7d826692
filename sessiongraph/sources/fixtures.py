"""Logical input tables derived from the driver's parquet tables.

Each function builds one input of the engine (views, logs, catalog, vectors, scored pairs) from a
given table, so every query's work grows with that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongraph.session import partitions_for
from sessiongraph.sources.tables import load

# Fixed values of the derived tables.
LOG_CANDIDATES = 16
SESSION_TIMEOUT = 14_400
CUTOFF_TRAIN = "2024-01-21"
CUTOFF_VAL = "2024-01-26"
TOP_K = 12
VECTOR_DIM = 64
MODEL_ID = "cur"


def item_events(spark: SparkSession, location: str) -> DataFrame:
    return load(spark, location, "events").select(
        "event_id",
        "user_id",
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("item_id"),
        "ts",
        "event_type",
        "value",
    )


def identity_map(spark: SparkSession, location: str) -> DataFrame:
    users = load(spark, location, "events").select("user_id").distinct()
    return users.where(F.col("user_id") % 10 == 1).select(
        F.col("user_id").alias("source_id"), (F.col("user_id") - 1).alias("master_id")
    )


def view_events(spark: SparkSession, location: str) -> DataFrame:
    return item_events(spark, location).select(
        F.concat(F.lit("a"), (F.col("user_id") % 25).cast("string")).alias("account_id"),
        F.col("ts").alias("emitted"),
        "item_id",
        "user_id",
        F.col("user_id").alias("cookie"),
    )


def recommendation_logs(spark: SparkSession, location: str) -> DataFrame:
    """One row per execution; `placements` is array<struct<candidates: array<struct<item_id, score>>>>.

    The candidate lists follow from the row alone, so no shuffle is needed to nest them.
    """
    clicks = item_events(spark, location).where(F.col("event_type") == "click")

    def candidate(p, c):
        item = (F.col("item_id") * 7 + c * 13 + p * 5) % 100
        score = ((item * 37 + F.col("event_id")) % 101).cast("double") / F.lit(100.0)
        hidden = (F.col("event_id") + c) % 17 == 0
        return F.struct(item.alias("item_id"), F.when(~hidden, score).alias("score"))

    positions = F.sequence(F.lit(0).cast("long"), F.lit(LOG_CANDIDATES - 1).cast("long"))
    n_placements = F.when(F.col("event_id") % 4 == 0, 2).otherwise(1).cast("long")
    placements = F.transform(
        F.sequence(F.lit(0).cast("long"), n_placements - 1),
        lambda p: F.struct(F.transform(positions, lambda c: candidate(p, c)).alias("candidates")),
    )
    return clicks.select(
        F.col("event_id").alias("execution_id"),
        (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, event_id % 9 - 4)")).alias("log_instant"),
        F.concat(F.lit("a"), (F.col("user_id") % 25).cast("string")).alias("account_id"),
        F.concat(F.lit("p"), (F.col("event_id") % 100).cast("string")).alias("publisher_id"),
        F.col("user_id").alias("cookie"),
        "item_id",
        F.when(F.col("event_id") % 10 == 0, "SEARCH").otherwise("PRODUCT").alias("page_type"),
        placements.alias("placements"),
    )


def accounts(spark: SparkSession, location: str) -> DataFrame:
    return load(spark, location, "nation").select(
        F.col("n_name").alias("short_name"),
        F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("public_id"),
        F.concat(F.lit("db"), F.col("n_regionkey").cast("string")).alias("db_name"),
    )


def insights_accounts(spark: SparkSession, location: str) -> DataFrame:
    return load(spark, location, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("a"), F.col("s_nationkey").cast("string")).alias("public_id"),
        F.when(F.col("s_suppkey") % 3 == 0, "other").otherwise("main").alias("namespace"),
    )


def publishers(spark: SparkSession, location: str) -> DataFrame:
    return (
        load(spark, location, "supplier")
        .where(F.col("s_suppkey") % 4 != 1)
        .select(
            F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("id"),
            F.col("s_suppkey").alias("insights_id"),
        )
    )


def catalog(spark: SparkSession, location: str) -> DataFrame:
    item = F.col("item_id")
    return (
        item_events(spark, location)
        .select("item_id")
        .distinct()
        .select(
            "item_id",
            F.concat(F.lit("db"), (item % 5).cast("string")).alias("db_name"),
            (item % 10 != 9).alias("is_active"),
            (item % 7 != 6).alias("is_in_stream"),
            F.when(item % 11 == 10, item - 1).otherwise(F.lit(-1)).alias("parent_id"),
            F.concat(F.lit("item "), item.cast("string")).alias("name"),
            F.concat(F.lit("img/"), item.cast("string")).alias("image_url"),
        )
    )


def item_vectors(spark: SparkSession, location: str) -> DataFrame:
    """Two model versions per item in places: every third vector has an outdated copy as well."""
    base = load(spark, location, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("embedding").alias("vector"),
        F.when(F.col("vec_id") % 25 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("c"), F.col("label").cast("string")), F.lit("any")))
        .alias("categories"),
        F.when(F.col("vec_id") % 20 == 3, "old").otherwise("cur").alias("model_id"),
        F.concat(F.lit("db"), (F.col("vec_id") % 5).cast("string")).alias("db_name"),
        F.lit(2).alias("updated_at"),
    )
    stale = base.where(F.col("item_id") % 3 == 0).withColumn("updated_at", F.lit(1)).withColumn(
        "vector", F.transform("vector", lambda x: -x)
    )
    return base.unionByName(stale).withColumn("category", F.get("categories", F.lit(0))).drop("categories")


def scored_pairs(spark: SparkSession, location: str) -> DataFrame:
    return load(spark, location, "lineitem").select(
        F.col("l_orderkey").alias("group_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (F.round(F.col("l_discount") * 100).cast("double") - F.lit(5.0)).alias("score"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("item_id"),
    )


def baskets(spark: SparkSession, location: str) -> DataFrame:
    """Order lines as session views: customer, order, part; split by order date."""
    lines = load(spark, location, "lineitem").select("l_orderkey", "l_partkey")
    parts = partitions_for(spark, lines.count())
    lines = lines.repartition(parts, "l_orderkey")
    orders = load(spark, location, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = orders.repartition(parts, "o_orderkey")
    day = F.col("o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("session_id"),
        F.col("l_partkey").alias("item_id"),
        day.alias("emitted"),
        day.alias("session_start"),
        F.when(day < F.lit("2000-01-01").cast("timestamp_ntz"), "train")
        .when(day < F.lit("2000-10-01").cast("timestamp_ntz"), "val")
        .otherwise("test")
        .alias("split"),
    )


def shipped_months(spark: SparkSession, location: str) -> DataFrame:
    """(item_id, month) of every order line."""
    return load(spark, location, "lineitem").select(
        F.col("l_partkey").alias("item_id"), F.month("l_shipdate").alias("month")
    )


def class_scores(spark: SparkSession, location: str) -> DataFrame:
    """(row_id, scores, target, mask): the vector entries taken as class scores."""
    return load(spark, location, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("scores"),
        F.col("label").alias("target"),
        (F.col("vec_id") % 4 != 0).alias("mask"),
    )
