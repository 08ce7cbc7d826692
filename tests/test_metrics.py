from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sessiongraph.operators import ranking_metrics as rm
from sessiongraph.operators import sampling

PAIR = "group_id long, label int, score double"


def data(seed):
    rng = random.Random(seed)
    return [(rng.randrange(6), int(rng.random() < 0.4), float(rng.randrange(-3, 4))) for _ in range(120)]


def hits(pos, neg, k):
    if not pos:
        return 0.0
    if len(neg) < k:
        return 1.0
    kth = sorted(neg, reverse=True)[k - 1]
    return sum(p > kth for p in pos) / len(pos)


def by_group(pairs):
    for g in sorted({p[0] for p in pairs}):
        yield [p[2] for p in pairs if p[0] == g and p[1]], [p[2] for p in pairs if p[0] == g and not p[1]]


@pytest.mark.parametrize("seed", [1, 2])
def test_global_metrics(spark, seed):
    pairs = data(seed)
    pos, neg = [p[2] for p in pairs if p[1]], [p[2] for p in pairs if not p[1]]
    ladder = rm.score_ladder(spark.createDataFrame(pairs, PAIR)).cache()
    found = rm.hits_at(ladder, [1, 10, 1000]).first()
    assert tuple(found) == pytest.approx((hits(pos, neg, 1), hits(pos, neg, 10), 1.0))
    ranks = [0.5 * (sum(n > p for n in neg) + sum(n >= p for n in neg)) + 1 for p in pos]
    assert rm.mrr(ladder).first()[0] == pytest.approx(sum(1 / r for r in ranks) / len(ranks))
    wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    assert rm.roc_auc(ladder).first()[0] == pytest.approx(wins / (len(pos) * len(neg)))


@pytest.mark.parametrize("seed", [1, 2])
def test_group_metrics(spark, seed):
    pairs = data(seed) + [(90, 1, 0.0), (91, 0, 1.0)]
    df = spark.createDataFrame(pairs, PAIR)
    groups = list(by_group(pairs))
    ladder = rm.group_ladder(df).cache()
    with_positive = [g for g in groups if g[0]]
    for k, found in zip((1, 3), rm.group_hits_at(ladder, [1, 3]).first()):
        assert found == pytest.approx(sum(hits(p, n, k) for p, n in with_positive) / len(with_positive))
    mrr = [sum(1 / (1 + sum(n > p for n in neg)) for p in pos) / len(pos) for pos, neg in with_positive]
    assert rm.group_mrr(ladder).first()[0] == pytest.approx(sum(mrr) / len(mrr))
    found = rm.group_threshold_metrics(df).first()
    accuracy = [(sum(p > 0 for p in pos) + sum(n <= 0 for n in neg)) / len(pos + neg) for pos, neg in groups]
    precision = [sum(p > 0 for p in pos) / max(sum(s > 0 for s in pos + neg), 1) for pos, neg in groups]
    recall = [sum(p > 0 for p in pos) / len(pos) for pos, _ in with_positive]
    wanted = [sum(v) / len(v) for v in (accuracy, precision, recall)]
    assert tuple(found) == pytest.approx(wanted)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(1, 0, 0.5)], PAIR)
    assert rm.mrr(rm.score_ladder(df)).first()[0] == 0.0
    assert rm.group_mrr(rm.group_ladder(df)).first()[0] == 0.0
    assert rm.binary_metrics(df).first()["recall"] == 0.0


def test_class_metrics_agree_with_each_other(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], 1, True), ([3.0, 2.0], 1, True), ([9.0, 2.0], 1, False)],
        "scores array<double>, target int, mask boolean",
    )
    assert tuple(rm.class_metrics(df).first()) == (0.5, 0.5, 0.5, 0.5)
    assert tuple(rm.class_metrics(df.where("not mask")).first()) == (0.0, None, None, None)


def test_cap_negatives(spark):
    pos = spark.createDataFrame([(1,), (1,), (2,)], "g long")
    neg = spark.createDataFrame([(g, i) for g, n in ((1, 9), (2, 1), (3, 4)) for i in range(n)], "g long, i long")
    assert rows(sampling.cap_negatives(pos, neg, ["g"], ["i"], ratio=2)) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]


def test_epoch_sample(spark):
    pos = spark.createDataFrame([(0, i) for i in range(10)], "src long, dst long")
    neg = spark.createDataFrame([(1, i % 40) for i in range(80)], "src long, dst long")
    sample = sampling.epoch_sample(pos, neg, ratio=3).cache()
    assert sample.where("label = 1").count() == 10 and sample.where("label = 0").count() == 30
    assert [r[0] for r in rows(sample, "position")] == list(range(40))
    assert sample.where("label = 0").groupBy("src", "dst").count().where("count > 2").count() == 0
    assert rows(sample) == rows(sampling.epoch_sample(pos.repartition(3), neg.repartition(5), ratio=3))
    assert sampling.epoch_sample(pos, neg, ratio=50).where("label = 0").count() == 80
    other = sampling.epoch_sample(pos, neg, ratio=3, seed=7)
    assert rows(other.where("label = 0"), "dst") != rows(sample.where("label = 0"), "dst")


def test_random_non_edges(spark):
    pos = spark.createDataFrame([(a, (a * 7 + 3) % 50) for a in range(50)], "src long, dst long").where("src <> dst")
    nodes = spark.range(50)
    found = sampling.random_non_edges(pos, nodes, pos)
    known = {frozenset(r) for r in rows(pos)}
    drawn = rows(found, "src", "dst")
    assert len(drawn) == pos.count()
    assert all(a != b and frozenset((a, b)) not in known and 0 <= min(a, b) and max(a, b) < 50 for a, b in drawn)
    full = spark.createDataFrame([(a, b) for a in range(3) for b in range(3) if a < b], "src long, dst long")
    assert sampling.random_non_edges(full, spark.range(3), full).count() == 0
    outside = full.unionByName(spark.createDataFrame([(1, 7), (-1, 0), (2, 2), (1, 0)], "src long, dst long"))
    one_free = sampling.random_non_edges(full, spark.range(3), outside.where("not (src = 1 and dst = 2)"))
    assert {frozenset(r) for r in rows(one_free, "src", "dst")} == {frozenset((1, 2))} and one_free.count() == 3
    assert sampling.random_non_edges(full, spark.range(1), full).count() == 0


def test_every_free_pair_is_drawn(spark):
    """Many draws over a graph with a tenth of the pairs free reach all of them about equally often."""
    rng = np.random.default_rng(5)
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30)]
    free = {pairs[i] for i in rng.choice(len(pairs), 40, replace=False)}
    known = spark.createDataFrame([p for p in pairs if p not in free], "src long, dst long")
    positives = spark.range(8_000).select("id", (F.col("id") % 9).alias("other"))
    found = sampling.random_non_edges(positives, spark.range(30), known)
    counts = {}
    for r in found.collect():
        counts[min(r.src, r.dst), max(r.src, r.dst)] = counts.get((min(r.src, r.dst), max(r.src, r.dst)), 0) + 1
    assert set(counts) == free and min(counts.values()) > 120 and max(counts.values()) < 290


def test_places_of_pairs_of_many_nodes(spark):
    """The node of a place is exact for graphs of a billion nodes."""
    n = 1_000_000_000
    nodes = [(lo, hi) for lo in (0, 1, 12_345, n // 2, n - 3, n - 2) for hi in (lo + 1, (lo + n) // 2 + 1, n - 1) if lo < hi < n]
    df = spark.createDataFrame(nodes, "lo long, hi long")
    place = sampling._pair_number(F.col("lo"), F.col("hi"), n)
    found = df.select("lo", "hi", place.alias("place"))
    for lo, hi, at in rows(found):
        assert at == lo * (n - 1) - lo * (lo - 1) // 2 + hi - lo - 1
    assert rows(found.select(sampling._low_node(F.col("place"), n).alias("lo"))) == sorted((lo,) for lo, _ in nodes)


def test_stored_negatives(spark):
    pos = spark.createDataFrame([(0, i) for i in range(6)], "src long, dst long")
    neg = spark.createDataFrame([(9, i) for i in range(4)], "src long, dst long")
    drawn = sampling.draw_stored_negatives(pos, neg, ratio=5)
    assert drawn.count() == 30 and set(rows(drawn, "src", "dst")) <= set(rows(neg))
    assert sampling.draw_stored_negatives(pos, neg.where("src < 0")).count() == 0
    assert sampling.aligned_negatives(pos, neg).count() == 4
