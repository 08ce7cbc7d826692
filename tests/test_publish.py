from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from sessiongraph.operators import coview, labels, quality
from sessiongraph.plans.publish import publish


def test_only_tables_that_hold_replace_what_is_there(spark, tmp_path):
    path = str(tmp_path / "published" / "t")
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert publish(good, path, good.schema).first().asDict() == {
        "source": "table", "drifted_columns": 0, "rows_before": 2, "rows_after": 2, "published": True,
    }
    drifted = good.withColumn("id", F.col("id").cast("int")).withColumn("more", F.lit(1))
    report = publish(drifted, path, good.schema).first()
    assert (report.drifted_columns, report.rows_after, report.published) == (2, None, False)
    assert rows(spark.read.parquet(path), "id", "name") == [(1, "a"), (2, "b")]
    assert publish(good.limit(0), path, good.schema).first().published
    assert spark.read.parquet(path).count() == 0
    assert [p.name for p in (tmp_path / "published").iterdir()] == ["t"]


def test_exclusions_are_counted_in_one_pass(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (None, 7), (4, 9)], "a int, b int")
    a, b = F.col("a").isNotNull(), F.col("b") > 5
    counted = quality.passing(df, [("a", F.lit(True), a), ("b", a, b)])
    assert rows(counted, "step", "rows_in", "rows_out") == [("a", 4, 3), ("b", 3, 1)]
    assert rows(quality.passing(df.limit(0), [("a", F.lit(True), a)]), "step", "rows_in", "rows_out") == [("a", 0, 0)]


def test_trigger_is_left_out_of_lists_before_they_are_cut(spark):
    schema = "execution_id long, item_id long, placements array<struct<candidates: array<struct<item_id: bigint, score: double>>>>"
    logs = spark.createDataFrame([(1, 7, [([(7, 0.5), (8, None), (None, 0.1)],), (None,)]), (2, 7, None)], schema)
    kept = labels.without_trigger(logs).orderBy("execution_id").collect()
    assert [[c.item_id for c in p.candidates] if p.candidates else None for p in kept[0].placements] == [[8, None], None]
    assert kept[1].placements is None


def test_only_later_views_make_a_positive(spark):
    views = spark.createDataFrame(
        [("val", 1, 1, 8, "2024-01-01 10:00:00"), ("val", 1, 1, 9, "2024-01-01 12:00:00")],
        "split string, user_id long, session_id long, item_id long, emitted string",
    ).withColumn("emitted", F.col("emitted").cast("timestamp"))
    triggers = spark.createDataFrame(
        [("val", 1, 1, 5, 7)], "split string, user_id long, session_id long, execution_id long, trigger_id long"
    )
    logs = spark.createDataFrame(
        [(5, [([(8, 1.0), (9, 1.0), (3, 1.0)],)])],
        "execution_id long, placements array<struct<candidates: array<struct<item_id: bigint, score: double>>>>",
    ).withColumn("log_instant", F.lit("2024-01-01 11:00:00").cast("timestamp"))
    seen = coview.last_views(views)
    late = labels.label_candidates(triggers, logs, seen, after_log_only=True)
    assert rows(late.where("is_positive"), "item_id", "best_positive_rank") == [(9, 2)]
    assert rows(labels.label_candidates(triggers, logs, seen).where("is_positive"), "item_id") == [(8,), (9,)]


def test_pairs_shared_by_val_and_test_and_known_positives(spark):
    held = spark.createDataFrame(
        [("val", 1, 2), ("test", 1, 2), ("test", 1, 3)], "split string, item_a long, item_b long"
    )
    assert rows(coview.shared_held_out_pairs(held), "val_pairs", "test_pairs", "shared_pairs") == [(1, 2, 1)]
    found = spark.createDataFrame(
        [("val", 2, 1, True), ("val", 1, 2, True), ("val", 1, 9, True), ("val", 1, 3, False)],
        "split string, trigger_id long, item_id long, is_positive boolean",
    )
    train = spark.createDataFrame([(1, 2), (1, 3)], "item_a long, item_b long")
    assert rows(labels.known_positives(found, train), "split", "positives", "known") == [("val", 3, 2)]
