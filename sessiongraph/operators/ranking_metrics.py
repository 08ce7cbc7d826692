"""Metrics over scored pairs (group_id, label, score); a label above 0.5 is a positive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongraph.operators.index import running_sums

# Fixed value: scores are logits, so this is where the sigmoid crosses one half.
DEFAULT_THRESHOLD = 0.0


def is_positive() -> Column:
    return F.col("label") > 0.5


def score_counts(pairs: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, combined on the map side."""
    return pairs.groupBy(*within, "score").agg(
        F.count_if(is_positive()).alias("n_pos"), F.count_if(~is_positive()).alias("n_neg")
    )


def score_ladder(pairs: DataFrame) -> DataFrame:
    """(score, n_pos, n_neg, before_n_pos, before_n_neg); `before` counts the rows with a higher score.

    All global rank metrics read this one table. It never holds a positive-negative pair.
    """
    return running_sums(score_counts(pairs), [F.col("score").desc()], ["n_pos", "n_neg"])


def group_ladder(pairs: DataFrame) -> DataFrame:
    """`score_ladder` inside each group."""
    counts = score_counts(pairs, ["group_id"])
    return running_sums(counts, [F.col("score").desc()], ["n_neg"], ["group_id"])


def _reached(k: int) -> Column:
    """Positives of a ladder row that beat the k-th best negative.

    That is the case when fewer than k negatives score at least as high, which also covers groups with
    fewer than k negatives.
    """
    return F.when(F.col("before_n_neg") + F.col("n_neg") < k, F.col("n_pos")).otherwise(0)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def hits_at(ladder: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row: hits_<k>, the share of positives above the k-th best negative."""
    return ladder.agg(*[_share(F.sum(_reached(k)), F.sum("n_pos")).alias(f"hits_{k}") for k in ks])


def mrr(ladder: DataFrame) -> DataFrame:
    """One row: mean over the positives of 1 / rank among the negatives, ties at mid-rank."""
    rank = F.col("before_n_neg") + F.col("n_neg") * 0.5 + 1
    return ladder.agg(_share(F.sum(F.col("n_pos") / rank), F.sum("n_pos")).alias("mrr"))


def roc_auc(ladder: DataFrame) -> DataFrame:
    """One row: chance that a positive outscores a negative, ties counting one half."""
    beaten_above = F.col("n_neg") * (F.col("before_n_pos") + F.col("n_pos") * 0.5)
    return ladder.agg(
        _share(
            F.sum(beaten_above).cast("double"), F.sum("n_pos").cast("double") * F.sum("n_neg")
        ).alias("roc_auc")
    )


def group_hits_at(ladder: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row: per-group hits at each k, averaged over the groups with a positive."""
    per_group = ladder.groupBy("group_id").agg(
        F.sum("n_pos").alias("pos"), *[F.sum(_reached(k)).alias(f"reached_{k}") for k in ks]
    )
    with_positive = per_group.where(F.col("pos") > 0)
    return with_positive.agg(
        *[F.coalesce(F.avg(F.col(f"reached_{k}") / F.col("pos")), F.lit(0.0)).alias(f"group_hits_{k}") for k in ks]
    )


def group_mrr(ladder: DataFrame) -> DataFrame:
    """One row: mean over groups of the mean 1 / rank of their positives; a tie favors the positive."""
    per_group = ladder.groupBy("group_id").agg(
        F.sum("n_pos").alias("pos"), F.sum(F.col("n_pos") / (F.col("before_n_neg") + 1)).alias("rr")
    )
    return per_group.where(F.col("pos") > 0).agg(
        F.coalesce(F.avg(F.col("rr") / F.col("pos")), F.lit(0.0)).alias("group_mrr")
    )


def group_threshold_metrics(pairs: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row: accuracy, precision and recall at a score threshold, each averaged over groups.

    Accuracy and precision average over all groups, recall over the groups with a positive.
    """
    above = F.col("score") > threshold
    per_group = pairs.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.count_if(is_positive()).alias("pos"),
        F.count_if(is_positive() & above).alias("tp"),
        F.count_if(~is_positive() & above).alias("fp"),
        F.count_if(~is_positive() & ~above).alias("tn"),
    )
    return per_group.agg(
        _zero_if_empty(F.avg((F.col("tp") + F.col("tn")) / F.col("n"))).alias("group_accuracy"),
        _zero_if_empty(F.avg(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)))).alias(
            "group_precision"
        ),
        _zero_if_empty(F.avg(F.try_divide("tp", "pos"))).alias("group_recall"),
    )


def _zero_if_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def binary_metrics(pairs: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row: accuracy, share predicted positive, precision, recall and F1 over all pairs."""
    above = F.col("score") > threshold
    sums = pairs.agg(
        F.count("*").alias("n"),
        F.count_if(is_positive() & above).alias("tp"),
        F.count_if(~is_positive() & above).alias("fp"),
        F.count_if(is_positive() & ~above).alias("fn"),
        F.count_if(~is_positive() & ~above).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        (F.col("tp") + F.col("tn")).alias("correct"),
        _share(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        _share(tp + fp, F.col("n")).alias("predicted_positive"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def bce_loss(pairs: DataFrame) -> DataFrame:
    """One row: mean binary cross-entropy of the score taken as a logit."""
    x, y = F.col("score"), F.col("label").cast("double")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return pairs.agg(F.avg(loss).alias("bce"))


def cross_entropy_loss(rows: DataFrame) -> DataFrame:
    """One row: mean cross-entropy of class scores (scores array, target index)."""
    scores = F.col("scores")
    top = F.array_max(scores)
    spread = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return rows.agg(F.avg(top + F.log(spread) - F.get(scores, F.col("target"))).alias("cross_entropy"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """One row: accuracy and micro precision, recall and F1 of the best class over the masked-in rows.

    A row counts as predicted right when the first largest score is at the target. With one prediction
    per row, wrong predictions are both the false positives and the false negatives, hence the three
    micro scores equal the accuracy; they are null when the mask leaves nothing.
    """
    predicted = F.array_position("scores", F.array_max("scores")) - 1
    sums = rows.where("mask").agg(
        F.count_if(predicted == F.col("target")).alias("right"),
        F.count_if(predicted != F.col("target")).alias("wrong"),
    )
    right, wrong = F.col("right"), F.col("wrong")
    share = F.try_divide(right, right + wrong)
    return sums.select(
        F.coalesce(share, F.lit(0.0)).alias("accuracy"),
        share.alias("micro_precision"),
        share.alias("micro_recall"),
        F.try_divide(right * 2, right * 2 + wrong + wrong).alias("micro_f1"),
    )
