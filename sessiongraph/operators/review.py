"""A small sample of sessions with their lists, ready for people to look at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongraph.operators.index import running_sums
from sessiongraph.operators.rankings import item_ids

# Sample size and seed of the review page, and the multiplier and modulus of its order.
SAMPLE_SIZE = 20
SAMPLE_SEED = 56
ORDER_MULTIPLIER = 7919
ORDER_MODULUS = 1_000_003

TRIGGER = ["split", "exec_code"]
SESSION = ["split", "user_id", "session_id"]


def display_sample(
    owners: DataFrame, results: DataFrame, size: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED
) -> DataFrame:
    """`size` triggers that have a result, at most one per (split, trigger item), in a seeded order."""
    present = owners.join(results.select(*TRIGGER), TRIGGER, "left_semi")
    columns = [c for c in owners.columns if c not in ("split", "trigger_id")]
    first = F.min(F.struct("exec_code", *[c for c in columns if c != "exec_code"])).alias("first")
    one_each = present.groupBy("split", "trigger_id").agg(first).select("split", "trigger_id", "first.*")
    place = F.pmod(F.pmod("exec_code", F.lit(ORDER_MODULUS)) * ORDER_MULTIPLIER + seed, F.lit(ORDER_MODULUS))
    return one_each.orderBy(place, "split", "exec_code").limit(size)


def enriched_products(results: DataFrame, columns: list[str], metadata: DataFrame) -> DataFrame:
    """(split, exec_code, list, rank, item_id, name, image_url) for the given list columns."""
    lists = F.array(
        *[
            F.struct(
                F.lit(c).alias("list"),
                F.transform(c, lambda p: F.struct(p["rank"].alias("rank"), p["item_id"].alias("item_id"))).alias(
                    "products"
                ),
            )
            for c in columns
        ]
    )
    flat = results.select(*TRIGGER, F.inline(lists)).select(*TRIGGER, "list", F.inline("products"))
    return flat.join(metadata.select("item_id", "name", "image_url"), "item_id", "left").select(
        *TRIGGER, "list", "rank", "item_id", "name", "image_url"
    )


def referenced_items(
    sample: DataFrame, session_views: DataFrame, results: list[tuple[DataFrame, list[str]]]
) -> DataFrame:
    """Distinct item_id over triggers, their sessions, and the list columns of the result tables.

    `results` is a list of (table, list columns).
    """
    parts = [
        sample.select(F.col("trigger_id").alias("item_id")),
        session_views.join(sample.select(*SESSION).distinct(), SESSION, "left_semi").select("item_id"),
    ]
    for table, columns in results:
        chosen = keep_sample(table, sample)
        parts += [chosen.select(F.explode(item_ids(c)).alias("item_id")) for c in columns]
    return reduce(DataFrame.unionByName, parts).distinct()


def keep_sample(table: DataFrame, sample: DataFrame) -> DataFrame:
    """The rows of a full table that belong to the sample."""
    return table.join(sample.select(*TRIGGER).distinct(), TRIGGER, "left_semi")


def replay_checks(
    sample: DataFrame,
    results: DataFrame,
    list_column: str,
    referenced: DataFrame,
    metadata: DataFrame,
    source_items: DataFrame,
    size: int = SAMPLE_SIZE,
) -> DataFrame:
    """Long form (check, value) of what a page needs: sessions, unique metadata, lookups, empty lists.

    `dropped` counts referenced items without metadata although the source knows them; `unknown` those
    the source does not know either.
    """
    shown = sample.select(*TRIGGER).join(results.select(*TRIGGER, list_column), TRIGGER, "left")
    unresolved = referenced.join(metadata.select("item_id"), "item_id", "left_anti")
    source = source_items.select("item_id").distinct()
    repeated = metadata.groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)

    def check(name: str, counted: DataFrame, value: Column | None = None) -> DataFrame:
        chosen = F.count("*") if value is None else value
        return counted.agg(chosen.cast("long").alias("value")).select(F.lit(name).alias("check"), "value")

    return reduce(
        DataFrame.unionByName,
        [
            check("sessions", sample),
            check("missing_sessions", sample, F.greatest(F.lit(size) - F.count("*"), F.lit(0))),
            check("repeated_metadata", repeated),
            check("dropped", unresolved.join(source, "item_id", "left_semi")),
            check("unknown", unresolved.join(source, "item_id", "left_anti")),
            check("empty_lists", shown, F.count_if(F.coalesce(F.size(list_column), F.lit(0)) == 0)),
        ],
    )


def label_class(item: Column, positives: Column, negatives: Column) -> Column:
    """positive, negative or neutral, by membership of the item in the two lists."""
    return (
        F.when(F.array_contains(item_ids(positives), item), "positive")
        .when(F.array_contains(item_ids(negatives), item), "negative")
        .otherwise("neutral")
    )


def labelled_list(results: DataFrame, listed: str, positives: str, negatives: str) -> DataFrame:
    """(split, exec_code, rank, item_id, label_class) of one list column."""
    rows = results.select(
        *TRIGGER, F.col(positives).alias("pos"), F.col(negatives).alias("neg"), F.inline(listed)
    )
    return rows.select(
        *TRIGGER, "rank", "item_id", label_class(F.col("item_id"), F.col("pos"), F.col("neg")).alias("label_class")
    )


def first_occurrence(owners: DataFrame, session_views: DataFrame) -> DataFrame:
    """(split, exec_code, first_index): 0-based place of the trigger's first view in its session.

    Sessions are in (time, item) order; null if the trigger was never viewed. Places come from running
    counts over a range sort of the sessions concerned, so a session is never put in one list.
    """
    concerned = session_views.join(owners.select(*SESSION).distinct(), SESSION, "left_semi")
    counted = concerned.groupBy(*SESSION, "emitted", "item_id").agg(F.count("*").alias("n"))
    placed = running_sums(counted, [F.col("emitted"), F.col("item_id")], ["n"], SESSION)
    first = placed.groupBy(*SESSION, F.col("item_id").alias("trigger_id")).agg(
        F.min("before_n").alias("first_index")
    )
    return owners.join(first, [*SESSION, "trigger_id"], "left").select(*TRIGGER, "first_index")
