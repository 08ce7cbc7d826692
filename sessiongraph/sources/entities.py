"""Accounts, catalog and item vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: parent id that marks a master item.
MASTER_PARENT_ID = -1


def resolve_account(
    accounts: DataFrame,
    insights: DataFrame,
    publishers: DataFrame,
    short_name: str | None = None,
    namespace: str = "main",
    require_publisher: bool = True,
) -> DataFrame:
    """(short_name, account_id, db_name, publisher_id) of one account, or of all when no name is given.

    `require_publisher=False` keeps accounts whose insights rows have no publisher, with a null id.
    The result stays a DataFrame: later steps semi-join it instead of receiving collected lists.
    """
    wanted = accounts if short_name is None else accounts.where(F.col("short_name") == short_name)
    insights_rows = insights.where(F.col("namespace") == namespace).select(
        F.col("id").alias("insights_id"), "public_id"
    )
    links = publishers.select(F.col("id").alias("publisher_id"), "insights_id")
    how = "inner" if require_publisher else "left"
    return (
        wanted.join(insights_rows, "public_id")
        .join(links, "insights_id", how)
        .select("short_name", F.col("public_id").alias("account_id"), "db_name", "publisher_id")
    )


def of_databases(rows: DataFrame, databases: DataFrame | None) -> DataFrame:
    """Rows whose db_name occurs in `databases`; all rows when that is None."""
    if databases is None:
        return rows
    return rows.join(databases.select("db_name").distinct(), "db_name", "left_semi")


def active_master_items(catalog: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """Active, in-stream master items; `databases` (db_name) restricts the account databases."""
    rows = catalog.where(
        F.col("is_active") & F.col("is_in_stream") & (F.col("parent_id") == MASTER_PARENT_ID)
    )
    rows = of_databases(rows, databases)
    return rows.select(F.expr("try_cast(item_id as bigint)").alias("item_id"), "name", "image_url")


def current_vectors(vectors: DataFrame, model_id: str, databases: DataFrame | None = None) -> DataFrame:
    """One row per item: the latest vector computed by `model_id`.

    `max_by` keeps one running row per item on the map side, so an item with very many versions never
    becomes one big group. Equal dates fall back to the vector itself, which makes the pick repeatable.
    """
    rows = of_databases(vectors.where(F.col("model_id") == model_id), databases)
    version = F.struct("updated_at", "vector", "category")
    return (
        rows.groupBy(F.expr("try_cast(item_id as bigint)").alias("item_id"))
        .agg(F.max(version).alias("latest"))
        .select("item_id", "latest.vector", "latest.category", "latest.updated_at")
    )
