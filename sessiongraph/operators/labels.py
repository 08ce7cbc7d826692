"""Recommendation candidates labelled by what was seen in the session, and the negatives kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongraph.functions.draws import draw
from sessiongraph.operators.index import dense_index

# Fixed value: number of candidates read from each placement.
DEFAULT_DEPTH = 12

EXECUTION = ["split", "execution_id"]
LABEL_KEY = [*EXECUTION, "trigger_id", "item_id"]


def distinct_triggers(matched: DataFrame) -> DataFrame:
    """Distinct (split, user_id, session_id, execution_id, trigger_id) of the matched logs."""
    return matched.select(
        "split", "user_id", "session_id", "execution_id", F.col("item_id").alias("trigger_id")
    ).distinct()


def explode_candidates(
    logs: DataFrame, depth: int = DEFAULT_DEPTH, keys: Sequence[str] = ("execution_id",)
) -> DataFrame:
    """(*keys, placement_pos, rank, item_id): the first `depth` candidates of each placement.

    Ranks start at 1. Logs without placements and empty placements give no rows.
    """
    placements = logs.select(*keys, F.posexplode("placements").alias("placement_pos", "placement"))
    return placements.select(
        *keys,
        "placement_pos",
        F.posexplode(F.slice("placement.candidates", 1, depth)).alias("pos", "candidate"),
    ).select(
        *keys,
        "placement_pos",
        (F.col("pos") + 1).alias("rank"),
        F.expr("try_cast(candidate.item_id as bigint)").alias("item_id"),
    )


def without_trigger(logs: DataFrame) -> DataFrame:
    """Logs whose candidate lists no longer hold the item of the page itself; the others move up."""
    kept = F.transform(
        "placements",
        lambda p: p.withField(
            "candidates", F.filter(p["candidates"], lambda c: ~c["item_id"].eqNullSafe(F.col("item_id")))
        ),
    )
    return logs.withColumn("placements", kept)


def label_candidates(
    triggers: DataFrame,
    logs: DataFrame,
    items: DataFrame,
    depth: int = DEFAULT_DEPTH,
    after_log_only: bool = False,
) -> DataFrame:
    """One row per (split, execution_id, trigger_id, item_id) offered to a trigger.

    `rank` is the best rank offered, `is_positive` whether the item was seen in a session of the
    trigger (before or after, the trigger item included), `best_positive_rank` and
    `deepest_positive_rank` the ranks at which a seen item was offered.

    `items` are the distinct session items. The lookup joins on (session, item), so a very long
    session is spread over its items and no session is ever gathered. With `after_log_only` an item counts as
    seen only if it was viewed after the log was written; `items` then come from `coview.last_views`.
    """
    # Nested logs meet their triggers first, so that logs without a trigger are never exploded.
    timed = ["log_instant"] if after_log_only else []
    matched = triggers.join(logs.select("execution_id", "placements", *timed), "execution_id")
    offered = explode_candidates(matched, depth, [*triggers.columns, *timed]).drop("placement_pos")
    last = ["last_seen"] if after_log_only else []
    seen = items.select("split", "user_id", "session_id", "item_id", *last, F.lit(True).alias("viewed"))
    is_seen = F.col("viewed") & (F.col("last_seen") > F.col("log_instant")) if after_log_only else F.col("viewed")
    flagged = (
        offered.join(seen, ["split", "user_id", "session_id", "item_id"], "left")
        .withColumn("seen", is_seen)
        .withColumn("seen_rank", F.when(F.col("seen"), F.col("rank")))
    )
    return flagged.groupBy(*LABEL_KEY).agg(
        F.min("rank").alias("rank"),
        F.max(F.coalesce("seen", F.lit(False))).alias("is_positive"),
        F.min("seen_rank").alias("best_positive_rank"),
        F.max("seen_rank").alias("deepest_positive_rank"),
    )


def positive_pairs(labels: DataFrame) -> DataFrame:
    return labels.where("is_positive").select(*LABEL_KEY)


def known_positives(labels: DataFrame, train_edges: DataFrame) -> DataFrame:
    """Per split: positives, those whose pair is a train edge as well, and their share."""
    pairs = train_edges.select("item_a", "item_b", F.lit(True).alias("known"))
    ends = labels.where("is_positive").select(
        "split", F.least("trigger_id", "item_id").alias("item_a"), F.greatest("trigger_id", "item_id").alias("item_b")
    )
    counted = ends.groupBy("split", "item_a", "item_b").agg(F.count("*").alias("n"))
    return (
        counted.join(pairs, ["item_a", "item_b"], "left")
        .groupBy("split")
        .agg(
            F.sum("n").alias("positives"),
            F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("known"),
        )
        .withColumn("known_share", F.col("known") / F.col("positives"))
    )


def drawn_execution(fraction: float, seed: int) -> Column:
    """Whether the execution is in the seeded sample of `fraction` of all."""
    scale = 1_000_000
    return F.pmod(draw([F.col("execution_id")], seed), F.lit(scale)) < F.lit(int(fraction * scale))


def production_mrr(labels: DataFrame) -> DataFrame:
    """Per split: MRR of the best positive per execution, over matched and over all executions.

    The population is the executions with at least one candidate.
    """
    best = labels.groupBy(*EXECUTION).agg(F.min("best_positive_rank").alias("best"))
    summed = F.coalesce(F.sum(F.lit(1.0) / F.col("best")), F.lit(0.0))
    matched, total = F.count("best"), F.count("*")
    return best.groupBy("split").agg(
        total.alias("executions"),
        matched.alias("matched"),
        F.coalesce(F.try_divide(summed, matched), F.lit(0.0)).alias("mrr_matched_only"),
        (summed / total).alias("mrr_coverage_adjusted"),
        (matched / total).alias("coverage"),
    )


def known_pairs(edges: DataFrame) -> DataFrame:
    """Distinct pairs of an edge table in both directions."""
    forth = edges.select("item_a", "item_b")
    back = edges.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"))
    return forth.unionByName(back).distinct()


def unknown_candidates(labels: DataFrame, train_edges: DataFrame) -> DataFrame:
    """Candidates whose (trigger, item) pair is no train edge in either direction.

    The pair is put in ascending order and compared with the edges as stored, so the edge table is
    neither doubled nor deduplicated.
    """
    pair = train_edges.select("item_a", "item_b")
    return (
        labels.withColumn("item_a", F.least("trigger_id", "item_id"))
        .withColumn("item_b", F.greatest("trigger_id", "item_id"))
        .join(pair, ["item_a", "item_b"], "left_anti")
        .drop("item_a", "item_b")
    )


def negative_candidates(labels: DataFrame, train_edges: DataFrame) -> DataFrame:
    """Unknown candidates that were not seen in the session."""
    return unknown_candidates(labels.where(~F.col("is_positive")), train_edges)


def negatives_above_deepest(negatives: DataFrame, labels: DataFrame) -> DataFrame:
    """Negatives offered no deeper than the deepest positive of their execution."""
    deepest = (
        labels.where("is_positive")
        .groupBy(*EXECUTION)
        .agg(F.max("deepest_positive_rank").alias("deepest"))
    )
    return (
        negatives.join(deepest, EXECUTION)
        .where(F.col("rank") <= F.col("deepest"))
        .select(*LABEL_KEY, "rank")
    )


def negatives_without_positive(
    negatives: DataFrame, labels: DataFrame, fraction: float = 0.0, seed: int = 42
) -> DataFrame:
    """Negatives of a sample of the executions that have no positive at all.

    The sample is by hash of the execution, hence the same on every run and for every partitioning.
    """
    matched = labels.where("is_positive").select(*EXECUTION).distinct()
    rows = negatives.select(*LABEL_KEY, "rank")
    if fraction < 1.0:
        rows = rows.where(drawn_execution(fraction, seed))
    return rows.join(matched, EXECUTION, "left_anti")


def training_negatives(
    labels: DataFrame, train_edges: DataFrame, pure_fraction: float = 0.0, seed: int = 42
) -> DataFrame:
    """Negatives of matched executions, plus those of sampled executions without a positive."""
    negatives = negative_candidates(labels, train_edges)
    kept = negatives_above_deepest(negatives, labels)
    if pure_fraction <= 0.0:
        return kept
    return kept.unionByName(negatives_without_positive(negatives, labels, pure_fraction, seed))


def execution_codes(triggers: DataFrame) -> DataFrame:
    """(split, execution_id, exec_code): codes from 0 within each split, in ascending id order."""
    return dense_index(triggers, "execution_id", "exec_code", within=["split"])


def labelled_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Both label sets in one table with `is_positive`."""
    return positives.select(*LABEL_KEY, F.lit(True).alias("is_positive")).unionByName(
        negatives.select(*LABEL_KEY, F.lit(False).alias("is_positive"))
    )


def encode_pairs(pairs: DataFrame, codes: DataFrame, node_index: DataFrame) -> DataFrame:
    """(split, exec_code, src, dst, is_positive); pairs with an end outside the graph are dropped."""
    src = node_index.select(F.col("item_id").alias("trigger_id"), F.col("node_idx").alias("src"))
    dst = node_index.select("item_id", F.col("node_idx").alias("dst"))
    return (
        pairs.join(codes, EXECUTION)
        .join(src, "trigger_id")
        .join(dst, "item_id")
        .select("split", "exec_code", "src", "dst", "is_positive")
    )
