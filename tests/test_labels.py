from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sessiongraph.operators import labels, rankings
from sessiongraph.operators.coview import session_items

LOG = "execution_id long, placements array<struct<candidates: array<struct<item_id: long, score: double>>>>"


def log(execution, *placements):
    return (execution, [(p,) for p in placements])


def test_relevance_order_puts_missing_scores_last(spark):
    logs = spark.createDataFrame([log(1, [(4, 0.5), (3, None), (2, 0.9), (1, 0.5)])], LOG)
    ordered = logs.select(rankings.by_relevance(F.col("placements")[0]["candidates"]).alias("ids"))
    assert rows(ordered) == [([2, 1, 4, 3],)]


def test_merged_ranking_takes_the_best_position(spark):
    logs = spark.createDataFrame(
        [log(1, [(5, 0.1), (6, 0.2)], [(7, 0.9), (5, 0.8)]), log(2), (3, None), log(4, [])], LOG
    )
    found = {r.execution_id: (r.display, r.relevance) for r in rankings.ranked_lists(logs).collect()}
    assert found[1] == ([5, 7, 6], [6, 7, 5])
    assert found[2] == ([], []) and found[4] == ([], [])
    assert rows(rankings.ranked_lists(logs, 1).where("execution_id = 1"), "display") == [([5],)]


def setting(spark):
    views = spark.createDataFrame(
        [("val", 1, 1, i) for i in (10, 11, 12, 10)], "split string, user_id long, session_id long, item_id long"
    )
    triggers = spark.createDataFrame(
        [("val", 1, 1, 100, 10), ("val", 1, 1, 101, 11), ("val", 1, 1, 102, 12)],
        "split string, user_id long, session_id long, execution_id long, trigger_id long",
    )
    logs = spark.createDataFrame(
        [
            log(100, [(50, 0.5), (11, 0.4), (51, 0.3), (52, 0.2)], [(53, 0.1), (54, 0.1), (11, 0.9), (55, 0.1)]),
            log(101, [(60, 0.1), (61, 0.2)]),
            log(102),
        ],
        LOG,
    )
    return session_items(views), triggers, logs


def test_labels_and_negatives(spark):
    items, triggers, logs = setting(spark)
    made = labels.label_candidates(triggers, logs, items)
    assert rows(labels.positive_pairs(made)) == [("val", 100, 10, 11)]
    one = made.where("is_positive").first()
    assert (one.rank, one.best_positive_rank, one.deepest_positive_rank) == (2, 2, 3)
    edges = spark.createDataFrame([(10, 51), (11, 60)], "item_a long, item_b long")
    negatives = labels.negative_candidates(made, edges)
    assert rows(negatives, "execution_id", "item_id") == [
        (100, 50), (100, 52), (100, 53), (100, 54), (100, 55), (101, 61),
    ]
    kept = labels.training_negatives(made, edges)
    assert rows(kept, "execution_id", "item_id") == [(100, 50), (100, 53), (100, 54)]
    every = labels.training_negatives(made, edges, pure_fraction=1.0)
    assert rows(every, "execution_id", "item_id") == [(100, 50), (100, 53), (100, 54), (101, 61)]
    mrr = labels.production_mrr(made).first()
    assert (mrr.executions, mrr.matched, mrr.mrr_matched_only, mrr.mrr_coverage_adjusted) == (2, 1, 0.5, 0.25)


def test_prod_results_keep_executions_without_candidates(spark):
    items, triggers, logs = setting(spark)
    codes = labels.execution_codes(triggers)
    owners = rankings.one_trigger_per_execution(triggers, codes)
    prod = rankings.prod_results(rankings.prod_rankings(owners, logs, items))
    found = {r.exec_code: r for r in prod.collect()}
    assert sorted(found) == [0, 1, 2]
    assert [tuple(p) for p in found[0].positives_display] == [(11, 3)]
    assert [tuple(p) for p in found[0].positives_relevance] == [(11, 1)]
    assert found[2].products_returned_display == [] and found[2].positives_display == []
    both = [sorted(map(tuple, r.positives_display + r.negatives_display)) for r in found.values()]
    assert both == [sorted(map(tuple, r.products_returned_display)) for r in found.values()]


@pytest.mark.parametrize("listed_items", [1, 3, 64])
def test_short_and_long_sessions_mark_the_same_items(spark, monkeypatch, listed_items):
    """Items are seen alike whether a session's items come as one list or are looked up; a log may be there twice."""
    monkeypatch.setattr(rankings, "LISTED_ITEMS", listed_items)
    viewed = {1: [4], 2: [2, 4, 6], 3: list(range(0, 40, 3)), 4: []}
    items = spark.createDataFrame(
        [("val", u, 1, i) for u, found in viewed.items() for i in found],
        "split string, user_id long, session_id long, item_id long",
    )
    owners = spark.createDataFrame(
        [("val", 10 * u + e, 7, u, 1, 10 * u + e) for u in viewed for e in range(3)],
        "split string, execution_id long, trigger_id long, user_id long, session_id long, exec_code long",
    )
    offered = {10 * u + e: [(7 * e + u * c) % 20 for c in range(1, 7)] for u in viewed for e in range(2)}
    logs = spark.createDataFrame(
        [(x, [([(i, 0.1) for i in found],)]) for x, found in [*offered.items(), (20, offered[20])]],
        "execution_id long, placements array<struct<candidates: array<struct<item_id: long, score: double>>>>",
    )
    flat = rankings.prod_rankings(owners, logs, items).collect()
    assert all(r.seen == (r.item_id in viewed[r.user_id]) for r in flat)
    assert {r.execution_id for r in flat if r.item_id is None} == {10 * u + 2 for u in viewed}
    results = [
        rows(rankings.prod_results(rankings.prod_rankings(owners, logs, items, flat=form))) for form in (True, False)
    ]
    assert results[0] == results[1] and len(results[0]) == 12
    for r in rankings.prod_results(rankings.prod_rankings(owners, logs, items, flat=False)).collect():
        shown = list(dict.fromkeys(offered.get(r.execution_id, [])))
        times = 2 if r.execution_id == 20 else 1
        assert [p.item_id for p in r.products_returned_display] == [i for i in shown for _ in range(times)]
        assert [p.item_id for p in r.positives_display] == [
            i for i in shown for _ in range(times) if i in viewed[r.user_id]
        ]


def test_owner_is_the_same_for_every_partitioning(spark):
    triggers = spark.createDataFrame(
        [("val", u, 1, 7, t) for u, t in ((5, 3), (4, 2), (9, 2))],
        "split string, user_id long, session_id long, execution_id long, trigger_id long",
    )
    codes = labels.execution_codes(triggers)
    for n in (1, 3):
        owner = rankings.one_trigger_per_execution(triggers.repartition(n), codes).first()
        assert (owner.trigger_id, owner.user_id) == (2, 4)


def test_sampled_executions_do_not_depend_on_partitions(spark):
    made = spark.range(500).select(
        F.lit("val").alias("split"), F.col("id").alias("execution_id"), F.lit(1).cast("long").alias("trigger_id"),
        F.lit(2).cast("long").alias("item_id"), F.lit(1).alias("rank"), F.lit(False).alias("is_positive"),
    )
    samples = [
        rows(labels.negatives_without_positive(made.repartition(n), made, 0.3), "execution_id") for n in (1, 6)
    ]
    assert samples[0] == samples[1] and 100 < len(samples[0]) < 200
