"""What each exclusion of a run removes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongraph.functions.times import within_days
from sessiongraph.operators import coview, labels
from sessiongraph.operators.quality import passing
from sessiongraph.plans.chain import Chain
from sessiongraph.sources import behavior, entities


def _two_tables(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """A step whose two sides are tables of their own."""
    sides = before.select(F.lit(False).alias("kept")).unionByName(after.select(F.lit(True).alias("kept")))
    counted = sides.agg(F.count_if(~F.col("kept")).alias("rows_in"), F.count_if("kept").alias("rows_out"))
    return counted.select(F.lit(name).alias("step"), "rows_in", "rows_out")


def loss_ledger(
    chain: Chain,
    accounts: tuple[DataFrame, DataFrame] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """(step, rows_in, rows_out) of the exclusions of a run, in the order of the flow (`e01` to `e19`).

    Exclusions on one table are counted in one pass over it, those by a join in one pass over the marked rows.
    `accounts` are all accounts (public_id) and the resolved ones (account_id); without them the first step has no
    row. `start` and `end` are the run's own unless given. Labels, edges and the tables after them are
    read as they are stored.
    """
    given, chosen = chain.inputs, chain.settings
    start, end = start or chosen.start, end or chosen.end
    parts = []
    if accounts is not None:
        parts.append(_resolved_accounts(*accounts))
    live = F.col("is_active") & F.col("is_in_stream")
    parts.append(
        passing(
            given.catalog,
            [("e02_active", F.lit(True), live), ("e03_master", live, F.col("parent_id") == entities.MASTER_PARENT_ID)],
        )
    )
    parts.append(passing(given.vectors, [("e04_model_version", F.lit(True), F.col("model_id") == chosen.model_id)]))
    user, item = F.col("user_id").isNotNull(), F.col("item_id").isNotNull()
    parts.append(
        passing(
            given.view_events,
            [
                ("e05_known_user", F.lit(True), user),
                ("e06_known_item", user, item),
                ("e07_date", user & item, within_days("emitted", start, end)),
            ],
        )
    )
    active = entities.active_master_items(given.catalog, given.accounts).select("item_id").distinct()
    resolved = behavior.resolve_views(given.view_events, given.identity, given.accounts, chosen.start, chosen.end)
    per_item = resolved.groupBy("item_id").agg(F.count("*").alias("n"))
    marked = per_item.join(active.withColumn("in_catalog", F.lit(True)), "item_id", "left")
    parts.append(_weighted("e08_catalog", marked, F.col("in_catalog")))
    sizes = coview.session_sizes(chain.items)
    parts.append(passing(sizes, [("e09_two_items", F.lit(True), F.col("session_size") > 1)]))
    held = chain.edges.where(F.col("split") != "train")
    known = chain.train_edges.select(*coview.PAIR, F.lit(True).alias("known"))
    parts.append(
        passing(held.join(known, coview.PAIR, "left"), [("e10_not_in_train", F.lit(True), F.col("known").isNull())])
    )
    pairs = behavior.match_logs_to_views(
        chain.logs, given.view_events, given.identity, given.accounts, given.accounts, chosen.start, chosen.end
    )
    matched = pairs.select("execution_id").distinct()
    parts.append(_two_tables("e11_matched_log", chain.logs, matched))
    attached = chain.matched.select("execution_id").distinct()
    parts.append(_two_tables("e12_session_found", matched, attached))
    offers = chain.triggers.join(chain.logs.select("execution_id", "placements"), "execution_id")
    sizes_of = F.transform("placements", lambda p: F.coalesce(F.size(p["candidates"]), F.lit(0)))
    counted = offers.select(F.coalesce(sizes_of, F.array().cast("array<int>")).alias("offered"))
    parts.append(
        passing(counted, [("e13_has_candidates", F.lit(True), F.exists("offered", lambda n: n > 0))])
    )
    all_of = F.aggregate("offered", F.lit(0), lambda acc, n: acc + F.greatest(n, F.lit(0)))
    top_of = F.aggregate("offered", F.lit(0), lambda acc, n: acc + F.least(F.greatest(n, F.lit(0)), F.lit(chosen.top_k)))
    parts.append(
        counted.agg(
            F.coalesce(F.sum(all_of), F.lit(0)).alias("rows_in"), F.coalesce(F.sum(top_of), F.lit(0)).alias("rows_out")
        ).select(F.lit("e14_depth").alias("step"), "rows_in", "rows_out")
    )
    parts.append(_negatives(chain))
    both = labels.labelled_pairs(chain.positives, chain.negatives)
    parts.append(_two_tables("e18_in_graph", both, chain.pairs))
    ranked = chain.triggers.where(F.col("split").isin(*chosen.ranking_splits))
    parts.append(_two_tables("e19_one_trigger", ranked, chain.owners))
    return reduce(DataFrame.unionByName, parts)


def _resolved_accounts(given: DataFrame, resolved: DataFrame) -> DataFrame:
    found = resolved.select(F.col("account_id").alias("public_id")).distinct()
    marked = given.join(found.withColumn("found", F.lit(True)), "public_id", "left")
    return passing(marked, [("e01_publisher", F.lit(True), F.col("found"))])


def _weighted(name: str, counted: DataFrame, passes: Column) -> DataFrame:
    """A step over rows that stand for `n` rows each."""
    kept = F.sum(F.when(passes, F.col("n")))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"), F.coalesce(kept, F.lit(0)).alias("rows_out")
    ).select(F.lit(name).alias("step"), "rows_in", "rows_out")


def _negatives(chain: Chain) -> DataFrame:
    """The three exclusions of negatives, counted over the labels with their marks."""
    chosen = chain.settings
    deepest = (
        chain.labels.where("is_positive").groupBy(*labels.EXECUTION).agg(F.max("deepest_positive_rank").alias("deepest"))
    )
    edges = chain.train_edges.select(*coview.PAIR, F.lit(True).alias("known"))
    marked = (
        chain.labels.where(~F.col("is_positive"))
        .withColumn("item_a", F.least("trigger_id", "item_id"))
        .withColumn("item_b", F.greatest("trigger_id", "item_id"))
        .join(edges, coview.PAIR, "left")
        .join(deepest, labels.EXECUTION, "left")
    )
    unknown, has_positive = F.col("known").isNull(), F.col("deepest").isNotNull()
    drawn = labels.drawn_execution(chosen.pure_negative_fraction, chosen.seed)
    if chosen.pure_negative_fraction >= 1.0:
        drawn = F.lit(True)
    return passing(
        marked,
        [
            ("e15_no_train_edge", F.lit(True), unknown),
            ("e16_above_deepest", unknown & has_positive, F.col("rank") <= F.col("deepest")),
            ("e17_drawn_execution", unknown & ~has_positive, drawn),
        ],
    )
