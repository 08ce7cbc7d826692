from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sessiongraph.operators import inverted_lists, retrieval


def vectors(spark, n=90, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[10] = x[11] = x[12] * 1.0
    category = [None if i % 13 == 0 else ("big" if i % 5 else "small") for i in range(n)]
    data = [(i, [float(v) for v in x[i]], category[i]) for i in range(n)]
    return x, category, spark.createDataFrame(data, "item_id long, vector array<double>, category string")


def setting(spark, n=90):
    x, category, table = vectors(spark, n)
    triggers = table.select(
        F.lit("val").alias("split"), F.col("item_id").alias("exec_code"), F.col("item_id").alias("trigger_id"), "category"
    )
    pool = table.where("category is not null").select("category", "item_id")
    return x, category, table, triggers, pool


def brute(x, category, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(len(x)):
        if category[q] is None:
            continue
        scored = [
            (-round(float(unit[q] @ unit[i]), 9), i) for i in range(len(x)) if i != q and category[i] == category[q]
        ]
        yield from ((q, rank, item) for rank, (_, item) in enumerate(sorted(scored)[:k], start=1))


@pytest.mark.parametrize("query_block,pool_block", [(3, 4), (1000, 1000)])
def test_block_search_matches_brute_force(spark, query_block, pool_block):
    x, category, table, triggers, pool = setting(spark)
    queries, candidates = retrieval.queries_and_pool(triggers, pool, table)
    found = retrieval.top_k_by_group(
        queries, candidates, "category", 5, query_block=query_block, pool_block=pool_block
    )
    assert rows(found, "query_id", "rank", "item_id") == sorted(brute(x, category, 5))


def test_exact_top_k_and_parity(spark):
    x, category, table, triggers, pool = setting(spark)
    found = retrieval.exact_top_k(triggers, pool, table, 5)
    assert rows(found, "exec_code", "rank", "item_id") == sorted(brute(x, category, 5))
    check = retrieval.check_against_pairwise(found, triggers, pool, table, 5)
    report = check.first()
    asked = sum(c is not None for c in category)
    assert report.checked == asked and report.same_ids == asked and report.mismatches == 0
    wrong = found.withColumn("score", F.col("score") + 0.1)
    assert retrieval.check_against_pairwise(wrong, triggers, pool, table, 5).first().mismatches == asked


def test_list_count_column(spark):
    sizes = {1: 1, 39: 1, 100: 2, 2048: 52, 1_000_000: 4000}
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    found = dict(rows(df.select("n", inverted_lists.list_count_column(F.col("n")))))
    assert found == sizes


def test_approximate_search(spark):
    x, category, table, triggers, pool = setting(spark, 300)
    exact = retrieval.exact_top_k(triggers, pool, table, 5).cache()
    every = inverted_lists.approximate_top_k(triggers, pool, table, 5, probes=100, iterations=2)
    assert rows(every, "exec_code", "rank", "item_id") == rows(exact, "exec_code", "rank", "item_id")
    one = inverted_lists.approximate_top_k(triggers, pool, table, 5, probes=1)
    measured = retrieval.recall_against_exact(triggers, one, exact).first()
    assert 0.2 < measured.mean_recall < 1.0
    bounded = inverted_lists.approximate_top_k(triggers, pool, table, 5, probes=1, bounded=True, iterations=2)
    assert rows(bounded, "exec_code", "rank", "item_id") == rows(exact, "exec_code", "rank", "item_id")
    calibrated = inverted_lists.approximate_top_k(triggers, pool, table, 5, recall=0.9)
    assert retrieval.recall_against_exact(triggers, calibrated, exact).first().mean_recall > 0.85
    assert retrieval.recall_against_exact(triggers, exact, exact).first().mean_recall == 1.0
    half = exact.where("rank <= 2")
    recall = retrieval.recall_against_exact(triggers, half, exact).first()
    assert 0.4 < recall.mean_recall < 0.55 and recall.triggers == len(x)


def test_no_pool_gives_no_rows(spark):
    x, category, table, triggers, pool = setting(spark)
    assert retrieval.exact_top_k(triggers, pool.where("category = 'none'"), table, 5).count() == 0


def test_model_results_keep_unanswered_triggers(spark):
    triggers = spark.createDataFrame(
        [("val", 0, 1, 1, 1), ("val", 1, 2, 1, 1)],
        "split string, exec_code long, trigger_id long, user_id long, session_id long",
    )
    found = spark.createDataFrame(
        [("val", 0, 5, 0.5, 2), ("val", 0, 6, 0.9, 1)],
        "split string, exec_code long, item_id long, score double, rank int",
    )
    items = spark.createDataFrame([("val", 1, 1, 5)], "split string, user_id long, session_id long, item_id long")
    results = {r.exec_code: r for r in retrieval.model_results(triggers, found, items).collect()}
    assert [tuple(p) for p in results[0].products_returned] == [(6, 0.9, 1), (5, 0.5, 2)]
    assert [tuple(p) for p in results[0].positives] == [(5, 0.5, 2)]
    assert results[1].products_returned == [] and results[1].negatives == []


def test_small_scores_keep_their_order(spark):
    rows = [(i, [float(i), 1.0], "c") for i in range(1, 7)] + [(7, None, "c"), (8, [float("nan"), 1.0], "c")]
    ranks = []
    for size in (1.0, 1e-6):
        scaled = [(i, None if v is None else [x * size for x in v], c) for i, v, c in rows]
        table = spark.createDataFrame(scaled, "item_id long, vector array<double>, category string")
        triggers = table.selectExpr("'s' as split", "item_id as exec_code", "item_id as trigger_id", "category")
        found = retrieval.linear_top_k(triggers, table.select("category", "item_id"), table, 2, [1.0, 1.0])
        ranks.append(sorted((r["exec_code"], r["rank"], r["item_id"]) for r in found.collect()))
    assert ranks[0] == ranks[1]
    assert {r[2] for r in ranks[1]} == {4, 5, 6}


def test_bounds_close_lists_of_clustered_vectors(spark):
    """Tight clusters: few lists stay open, and what they hold is the exact answer."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 16)) * 5
    x = np.concatenate([c + 0.1 * rng.normal(size=(60, 16)) for c in centers])
    data = [(i, [float(v) for v in row], "c") for i, row in enumerate(x)]
    table = spark.createDataFrame(data, "item_id long, vector array<double>, category string")
    triggers = table.selectExpr("'s' as split", "item_id as exec_code", "item_id as trigger_id", "category")
    pool = table.select("category", "item_id")
    queries, candidates = retrieval.queries_and_pool(triggers, pool, table)
    members, lists = inverted_lists.build_lists(candidates, iterations=8)
    assert members.count() == len(x) and rows(members, "item_id") == [(i,) for i in range(len(x))]
    n_lists = lists.count()
    asked = queries.withColumn("probes", F.lit(2)).withColumn("least", F.lit(0.99))
    opened = inverted_lists._choose(asked, lists).count()
    assert opened < 0.3 * n_lists * len(x)
    found = inverted_lists.approximate_top_k(triggers, pool, table, 7, probes=1, bounded=True)
    exact = retrieval.exact_top_k(triggers, pool, table, 7)
    assert rows(found, "exec_code", "rank", "item_id") == rows(exact, "exec_code", "rank", "item_id")


def test_square_in_tiles_matches_brute_force_and_skips():
    from sessiongraph.functions.blocks import square_best

    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16)) * 5
    pool = np.repeat(centers, 50, axis=0) + rng.normal(size=(600, 16)) * 0.05
    pool[7] = pool[3]
    pool[20] = 0.0
    queries = pool[::5].copy()
    query_ids, item_ids = np.arange(0, 600, 5), np.arange(600)
    for shape in ((queries, pool), (queries[:1], pool), (queries, pool[:3]), (queries * 1e-6, pool)):
        asked, kept = shape
        n = len(kept)
        scores, ids, looked = square_best(asked, query_ids[: len(asked)], kept, item_ids[:n], 4, True, 16, 32)
        exact = asked @ kept.T
        exact[query_ids[: len(asked), None] == item_ids[None, :n]] = -np.inf
        largest = np.abs(exact[np.isfinite(exact)]).max()
        for row in range(len(asked)):
            order = sorted(range(n), key=lambda i: (-round(exact[row, i] / largest, 9), i))
            wanted = [i for i in order if np.isfinite(exact[row, i])][:4]
            assert [i for i, s in zip(ids[row], scores[row]) if np.isfinite(s)] == wanted
    _, _, looked = square_best(queries, query_ids, pool, item_ids, 4, True, 16, 32)
    assert looked < len(queries) / 16 * 600 / 32 / 2


def test_newton_fit_matches_a_dense_solver(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.4 + x @ [1.5, -0.7])))).astype(float)
    data = [(float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(400)] + [(None, 1.0, 1.0), (1.0, None, 9.0)]
    examples = spark.createDataFrame(data, "label double, a double, b double")
    weights = np.array(retrieval.fit_by_newton(examples, ["a", "b"], l2=0.05))
    full = np.column_stack([np.ones(400), x])
    chance = 1 / (1 + np.exp(-full @ weights))
    assert np.abs(full.T @ (chance - y) / 400 + 0.05 * np.array([0, *weights[1:]])).max() < 1e-9
    assert retrieval.fit_by_newton(examples.limit(0), ["a", "b"]) == [0.0, 0.0, 0.0]


def test_a_query_travels_once_per_shelf_and_not_once_per_list(spark):
    x, category, table, triggers, pool = setting(spark, 400)
    queries, candidates = retrieval.queries_and_pool(triggers, pool, table)
    members, lists = inverted_lists.build_lists(candidates, iterations=2)
    asked = inverted_lists._cut(queries.withColumn("probes", F.lit(1 << 20)), lists)
    assert lists.count() > 5 and asked.count() == queries.count()
    found = inverted_lists._search(
        asked.withColumn("least", F.lit(-2.0)), members, lists, 5, query_square=64, pool_square=40
    )
    found = retrieval.keep_best(found, ["category", "query_id"], 5)
    assert rows(found, "query_id", "rank", "item_id") == sorted(brute(x, category, 5))


def test_lists_beyond_the_cutoff_or_below_the_score_to_beat_stay_closed():
    rng = np.random.default_rng(8)
    centers = np.eye(6)
    near = [np.eye(6)[i] + 0.02 * rng.normal(size=(30, 6)) for i in range(6)]
    near = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in near]
    members = [(v, np.arange(30) + 30 * i) for i, v in enumerate(near)]
    reach = np.array([np.arccos(v @ c).max() for v, c in zip(near, centers)])
    queries, ids = np.concatenate([v[:5] for v in near]), np.concatenate([m[1][:5] for m in members])
    none, all_lists = np.full(30, -2.0), np.concatenate(near)
    exact = queries @ all_lists.T
    exact[np.arange(30), ids] = -np.inf
    wanted = np.sort(np.argsort(-exact, axis=1)[:, :4], axis=1)
    for cutoff, least in ((none, none), (np.full(30, 0.5), none), (none, np.full(30, 0.9))):
        scores, found, computed = inverted_lists.shelf_best(queries, ids, cutoff, least, centers, reach, members, 4, 8)
        assert (np.sort(found, axis=1) == wanted).all() and computed == 30 * 30


def test_a_square_holds_one_large_array_of_scores():
    import tracemalloc

    from sessiongraph.functions.blocks import square_best

    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(4096, 8))
    tracemalloc.start()
    square_best(vectors[:1024], np.arange(1024), vectors, np.arange(4096), 5, True, 1024, 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 1024 * 4096 * 8
