from __future__ import annotations

import itertools
import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sessiongraph import session
from sessiongraph.operators import coview, index, propagation


def baskets(spark, seed=3):
    rng = random.Random(seed)
    data = [
        ("train", user, session, rng.randrange(40))
        for user in range(4)
        for session, size in enumerate((1, 2, 5, 60))
        for _ in range(size)
    ]
    return data, spark.createDataFrame(data, "split string, user_id long, session_id long, item_id long")


@pytest.mark.parametrize("normalize", [False, True])
@pytest.mark.parametrize("block_items", [2, 7, 4096])
def test_edges_match_brute_force(spark, normalize, block_items):
    data, df = baskets(spark)
    weight, count = Counter(), Counter()
    for user, session in {(d[1], d[2]) for d in data}:
        items = sorted({d[3] for d in data if (d[1], d[2]) == (user, session)})
        for pair in itertools.combinations(items, 2):
            weight[pair] += 1 / (len(items) - 1) if normalize else 1
            count[pair] += 1
    found = {
        (r.item_a, r.item_b): (r.weight, r.raw_count)
        for r in coview.co_view_edges(df, normalize, block_items=block_items).collect()
    }
    assert found.keys() == count.keys()
    for pair, (w, n) in found.items():
        assert n == count[pair] and w == pytest.approx(weight[pair])


def test_held_out_edges_drop_train_pairs(spark):
    edges = spark.createDataFrame(
        [("train", 1, 2), ("val", 1, 2), ("val", 1, 3), ("test", 1, 3)], "split string, item_a long, item_b long"
    )
    assert rows(coview.held_out_edges(edges)) == [("test", 1, 3), ("train", 1, 2), ("val", 1, 3)]


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_dense_index_is_a_bijection_in_order(spark, bits):
    rng = random.Random(5)
    ids = {rng.randrange(-(2**63), 2**63) for _ in range(300)} | set(range(-20, 500)) | {2**63 - 1, -(2**63)}
    df = spark.createDataFrame([(s, i) for s in "ab" for i in ids if s == "a" or i % 2], "s string, id long")
    for s, group in itertools.groupby(rows(index.dense_index(df, "id", "idx", ["s"], bits)), key=lambda r: r[0]):
        group = list(group)
        assert [r[1] for r in group] == sorted(i for i in ids if s == "a" or i % 2)
        assert [r[2] for r in group] == list(range(len(group)))


def test_dense_index_does_not_depend_on_partitions(spark):
    ids = spark.range(1000).select((F.col("id") * 37 % 1009).alias("id"))
    one = rows(index.dense_index(ids.coalesce(1), "id", "idx"))
    assert one == rows(index.dense_index(ids.repartition(7), "id", "idx"))


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_running_sums_within_groups(spark, monkeypatch, partitions):
    monkeypatch.setattr(index, "shuffle_partitions", lambda _: partitions)
    rng = random.Random(9)
    sizes = {0: 400, 1: 1, 2: 3, None: 90, 4: 2}
    data = [(g, str(g), i, rng.randrange(4)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "g long, h string, i long, n long").repartition(5)
    found = index.running_sums(df, [F.col("i").desc()], ["n"], ["g", "h"])
    assert found.count() == len(data)
    for g, i, n, before in rows(found, "g", "i", "n", "before_n"):
        assert before == sum(x[3] for x in data if x[0] == g and x[2] > i)
    whole = index.running_sums(df, [F.col("i"), F.col("h")], ["n"])
    for h, i, before in rows(whole, "h", "i", "before_n"):
        assert before == sum(x[3] for x in data if (x[2], x[1]) < (i, h))
    assert index.running_sums(df.limit(0), [F.col("i")], ["n"], ["g"]).count() == 0


def test_running_sums_take_more_partitions_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(index, "partitions_for", lambda _, rows: rows // 10)
    df = spark.range(90).select("id", F.lit(1).alias("n"))
    sizes = []
    monkeypatch.setattr(index, "materialize", lambda df, name: (sizes.append(df.rdd.getNumPartitions()), session.materialize(df, name))[1])
    found = index.running_sums(df, [F.col("id")], ["n"], rows=90)
    assert sizes == [9]
    assert rows(found, "id", "before_n") == [(i, i) for i in range(90)]


def test_batches(spark):
    df = spark.createDataFrame([(i % 3, i % 5) for i in range(25)], "a long, b long")
    batched = index.batch_ids(df, [F.col("a").desc(), F.col("b")], 10)
    assert [r[0] for r in rows(batched, "row_idx")] == list(range(25))
    assert rows(batched.groupBy("batch_id").count()) == [(0, 10), (1, 10), (2, 5)]
    ordered = [r[1:] for r in rows(batched, "row_idx", "a", "b")]
    assert ordered == sorted(ordered, key=lambda r: (-r[0], r[1]))
    assert rows(index.batch_count(df, 10)) == [(3,)]
    assert rows(index.batch_count(df.where("a > 9"), 10)) == [(1,)]


def test_edge_list_operators(spark):
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (2, 0)], "src long, dst long")
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "node_idx long")
    assert rows(coview.unique_edges(edges)) == [(0, 1), (1, 1), (2, 0)]
    assert rows(coview.without_self_loops(edges)) == [(0, 1), (2, 0)]
    assert rows(coview.with_self_loops(edges, nodes)) == [(0, 0), (0, 1), (1, 1), (2, 0), (2, 2)]
    assert rows(coview.to_undirected(edges.where("src = 2"))) == [(0, 2), (2, 0)]
    removed = spark.createDataFrame([(0, 2)], "src long, dst long")
    assert rows(coview.mask_edges(edges, removed)) == [(0, 1), (0, 1), (1, 1)]


def test_propagation_matches_the_matrix_form(spark):
    n, dim = 5, 3
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, dim))
    pairs = [(0, 1), (0, 2), (3, 1)]
    both = [(a, b, 2.0) for a, b in pairs] + [(b, a, 2.0) for a, b in pairs]
    edges = spark.createDataFrame(both, "src long, dst long, weight double")
    vectors = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "node_idx long, vector array<double>")

    def matrix(value):
        a = np.eye(n)
        for s, d, _ in both:
            a[d, s] += value
        scale = np.diag(1 / np.sqrt(a.sum(axis=1)))
        return scale @ a @ scale

    def found(df):
        return np.array([r.vector for r in df.orderBy("node_idx").collect()])

    assert np.allclose(found(propagation.normalized_sum(edges, vectors)), matrix(1.0) @ x)
    assert np.allclose(found(propagation.normalized_sum(edges, vectors, weighted=True)), matrix(2.0) @ x)
    assert np.allclose(found(propagation.propagate(edges, vectors, 2)), matrix(1.0) @ matrix(1.0) @ x)
    means = {r.node_idx: r.vector for r in propagation.neighbor_mean(edges, vectors).collect()}
    assert sorted(means) == [0, 1, 2, 3]
    assert np.allclose(means[0], (x[1] + x[2]) / 2)


def test_propagation_in_small_blocks(spark, monkeypatch):
    """A hub with edges from and to all nodes, cut into blocks of nodes, chunks of edges and slices."""
    n, dim = 60, 4
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    pairs = [(0, i) for i in range(1, n)] + [(int(a), int(b)) for a, b in rng.integers(1, n, (80, 2)) if a != b]
    both = [(a, b, float(1 + (a + b) % 3)) for a, b in pairs] + [(b, a, float(1 + (a + b) % 3)) for a, b in pairs]
    edges = spark.createDataFrame(both, "src long, dst long, weight double")
    vectors = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "node_idx long, vector array<double>")
    monkeypatch.setattr(propagation, "SLICE_NUMBERS", 12)
    blocked = propagation.blocked_edges(edges.withColumnRenamed("weight", "w"), node_block=16, edge_chunk=20)
    assert blocked.where("block = 0").select("chunk").distinct().count() > 2
    sums = propagation._added(propagation._sums(blocked, vectors, node_block=16))
    a = np.zeros((n, n))
    for s, d, w in both:
        a[d, s] += w
    found = {r.node_idx: (r.total, r.n) for r in sums.collect()}
    degree = np.bincount([d for _, d, _ in both], minlength=n)
    for node, (total, count) in found.items():
        assert np.allclose(total, (a @ x)[node]) and count == degree[node]
    assert sorted(found) == np.flatnonzero(degree).tolist()
    full = a + np.eye(n)
    scale = np.diag(1 / np.sqrt(full.sum(axis=1)))
    hops = propagation.propagate(edges, vectors, 3, weighted=True).orderBy("node_idx").collect()
    assert np.allclose([r.vector for r in hops], np.linalg.matrix_power(scale @ full @ scale, 3) @ x)


def test_node_features_fill_with_zeros(spark):
    nodes = spark.createDataFrame([(7, 0), (8, 1)], "item_id long, node_idx long")
    vectors = spark.createDataFrame([(8, [1.0, 2.0])], "item_id long, vector array<float>")
    assert rows(coview.node_features(nodes, vectors, 2)) == [(0, 7, [0.0, 0.0]), (1, 8, [1.0, 2.0])]


def test_tasks_of_sessions_and_pairs_grow_with_the_rows(spark, monkeypatch):
    """Sessions, their sizes, pairs and edges are dealt out by the number of rows, not by a fixed setting."""
    assert session.partitions_for(spark, 0) == 3
    assert session.partitions_for(spark, 10 * session.ROWS_PER_TASK + 1) == 11
    monkeypatch.setattr(coview, "partitions_for", lambda spark, rows, per=0: max(3, -(-rows // (40 if per else 20))))
    data, df = baskets(spark)
    items = coview.session_items(df)
    assert items.rdd.getNumPartitions() == -(-len(data) // 20)
    assert coview.session_sizes(items, 9).rdd.getNumPartitions() == 9
    views = Counter((d[1], d[2]) for d in data)
    bound = sum(n * (n - 1) // 2 for n in views.values())
    assert coview.co_view_edges(df).rdd.getNumPartitions() == -(-bound // 40)


def test_repeated_views_ask_for_no_more_pair_tasks(spark, monkeypatch):
    """Users who view the same items again and again make no further pairs, so they need no further tasks."""
    data, df = baskets(spark)
    repeated = df.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("again")
    monkeypatch.setattr(coview, "partitions_for", lambda spark, rows, per=0: max(3, -(-rows // (40 if per else 20))))
    monkeypatch.setattr(coview, "BOUNDED_PAIRS", 10_000)
    sizes = Counter((d[1], d[2]) for d in set(data))
    pairs = sum(n * (n - 1) // 2 for n in sizes.values())
    for normalize in (False, True):
        edges = coview.co_view_edges(repeated, normalize)
        assert edges.rdd.getNumPartitions() == -(-pairs // 40)
        assert rows(edges, "item_a", "item_b", "raw_count") == rows(
            coview.co_view_edges(df, normalize), "item_a", "item_b", "raw_count"
        )


def test_a_block_gives_one_partial_sum_per_target(spark):
    edges = spark.range(600).select((F.col("id") % 32).alias("src"), (F.col("id") % 19).alias("dst"), F.lit(1.0).alias("w"))
    blocked = propagation.blocked_edges(edges.distinct(), node_block=16, edge_chunk=20)
    vectors = spark.range(32).select(F.col("id").alias("node_idx"), F.array(F.col("id").cast("double")).alias("vector"))
    assert blocked.agg(F.max("chunks")).first()[0] > 2
    partial = propagation._sums(blocked, vectors, node_block=16)
    assert partial.count() == blocked.select("block", "dst").distinct().count()


def test_edges_are_stored_in_a_few_bytes_and_come_back(spark, monkeypatch):
    """Blocks, chunks, parts and weights of packed edges are those of the edges; far ids take the slower sort."""
    monkeypatch.setattr(propagation, "PACKED_EDGES", 700)
    far = 1 << 61
    rng = np.random.default_rng(5)
    data = {(int(a), int(b) + (far if b == 3 else 0), float(1 + b % 2)) for a, b in rng.integers(0, 300, (4_000, 2))}
    edges = spark.createDataFrame(sorted(data), "src long, dst long, w double").repartition(2)
    for wanted in (edges, edges.drop("w")):
        blocked = propagation.blocked_edges(wanted, node_block=100, edge_chunk=500)
        packed = propagation.packed_edges(blocked, 100, parts=2)
        found, cells = set(), set()
        for r in packed.collect():
            src = r.block * 100 + propagation.from_bytes(r.src, r.n)
            dst = r.low + np.cumsum(propagation.from_bytes(r.dst, r.n))
            assert (dst % 2 == r.part).all() and len(r.src) <= r.n
            w = np.broadcast_to(np.frombuffer(r.w), r.n)
            found |= set(zip(src.tolist(), dst.tolist(), w.tolist(), strict=True))
            cells |= {(r.block, r.chunk, d) for d in dst.tolist()}
        assert found == (data if "w" in wanted.columns else {(s, d, 1.0) for s, d, _ in data})
        assert cells == {(r.block, r.chunk, r.dst) for r in blocked.collect()}


def test_a_hop_sends_few_copies_of_vectors_and_sums():
    """With more nodes and edges a graph is cut into larger blocks and chunks, within the memory of a task."""
    for width in (12, 64, 384):
        before = None
        for nodes, edges in ((1_000, 90_000), (240_000, 22_000_000), (7_200_000, 650_000_000), (72_000_000, 6_500_000_000)):
            shape = propagation._shape(width, nodes, edges)
            assert shape["node_block"] * width <= propagation.BLOCK_NUMBERS + propagation.NODE_BLOCK * width
            assert shape["edge_chunk"] <= max(propagation.EDGE_CHUNK, propagation.CHUNK_NUMBERS // width)
            assert before is None or all(shape[k] >= before[k] for k in shape)
            before = shape
    shape = propagation._shape(12, 7_200_000, 650_000_000)
    blocks = 7_200_000 / shape["node_block"]
    # Each vector goes to the chunks of its block, each target comes out of at most all blocks.
    assert blocks + 650_000_000 / blocks / shape["edge_chunk"] < 14


def test_lean_tables_leave_no_shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(x) for x in folder.localDirsString()]

    def files():
        return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    before = files()
    df = spark.range(10_000).repartition(5, "id").groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    stored = session.materialize(df, "counts", lean=True)
    deadline = time.time() + 10
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before
    assert stored.agg(F.sum("n")).first()[0] == df.agg(F.sum("n")).first()[0] == 10_000
    with session.passing_table(df, "passing") as table:
        path = table.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert table.count() == 100 and os.path.isdir(path)
    assert not os.path.exists(path)
