"""The weighted co-view graph: items seen together in a session, and edge-list operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongraph.functions.vectors import zeros
from sessiongraph.session import materialize, partitions_for, released_shuffles

SESSION = ["user_id", "session_id"]
PAIR = ["item_a", "item_b"]
# Pairs that one task sums up.
PAIRS_PER_TASK = 1_000_000
# Pairs, and pairs per view, up to which the bound from view counts will do; above both, distinct items are counted.
BOUNDED_PAIRS = 16_000_000
BOUNDED_PAIRS_PER_VIEW = 16


def session_items(session_views: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct (split, user_id, session_id, item_id).

    Views are dealt out before they are compared, to as many tasks as their number asks for: hardly any of them repeat,
    so a pass that combines them on the map side would keep them all.
    """
    rows = session_views.select("split", *SESSION, "item_id")
    if parts is None:
        parts = partitions_for(rows.sparkSession, session_views.count())
    return rows.repartition(parts, "split", *SESSION, "item_id").distinct()


def last_views(session_views: DataFrame) -> DataFrame:
    """`session_items` with `last_seen`, the time of the item's last view in the session."""
    return session_views.groupBy("split", *SESSION, "item_id").agg(F.max("emitted").alias("last_seen"))


def session_sizes(items: DataFrame, parts: int | None = None) -> DataFrame:
    """Number of distinct items per session, from `session_items` rows, in `parts` partitions if given."""
    dealt = items if parts is None else items.repartition(parts, "split", *SESSION)
    return dealt.groupBy("split", *SESSION).agg(F.count("*").alias("session_size"))


def long_sessions(session_views: DataFrame, block_items: int, parts: int) -> tuple[DataFrame, int]:
    """Sizes of the sessions with more than `block_items` distinct items, written to the shared folder, and a bound
    on the number of pairs of all sessions.

    View counts narrow the search first; distinct items are counted for the few sessions left.
    """
    keys = ["split", *SESSION]
    counts = session_views.select(*keys).repartition(parts, *keys).groupBy(*keys).agg(F.count("*").alias("n"))
    # Views that repeat count as items here; a session of n views has n * (n - 1) / 2 pairs at most.
    with released_shuffles(session_views.sparkSession):
        bound = counts.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.max("n")).first()
    if (bound[1] or 0) <= block_items:
        none = session_views.select(*keys, F.lit(0).cast("long").alias("session_size"))
        return none.limit(0), int(bound[0] or 0)
    busy = materialize(counts.where(F.col("n") > block_items).drop("n"), "busy_sessions")
    sizes = session_sizes(session_items(session_views.join(busy, keys, "left_semi"), parts))
    return materialize(sizes.where(F.col("session_size") > block_items), "long_sessions"), int(bound[0])


def session_pairs(session_views: DataFrame, normalize: bool = False, block_items: int = 4096) -> DataFrame:
    """(split, item_a, item_b, pair_weight) for each item pair of each session, item_a < item_b.

    Sessions with more than `block_items` items take another way to the same pairs: their items are
    hashed into blocks and each pair of blocks is joined on its own key, so the work of one session is
    spread over many tasks and no task pairs more than two blocks. The list of such sessions is stored
    beforehand: Spark sees its size and takes them out before the shuffle if the list is small.
    """
    return _pairs_and_bound(session_views, normalize, block_items)[0]


def _pairs_and_bound(session_views: DataFrame, normalize: bool, block_items: int) -> tuple[DataFrame, int]:
    """`session_pairs`, and a bound on their number. Sessions are dealt to tasks whose number grows with the views.

    Where users repeat their views, the bound from view counts grows with the square of the repeats, and the pairs do
    not: above `BOUNDED_PAIRS` the distinct items are stored and the pairs counted from them.
    """
    spark, views = session_views.sparkSession, session_views.count()
    parts = partitions_for(spark, views)
    items = session_items(session_views, parts)
    large, bound = long_sessions(session_views, block_items, parts)
    if bound > max(BOUNDED_PAIRS, BOUNDED_PAIRS_PER_VIEW * views):
        items = materialize(items, "session_items")
        parts = partitions_for(spark, items.count())
        n = F.col("session_size")
        pairs = F.sum(n.cast("double") * (n - 1) / 2)
        bound = int(session_sizes(items, parts).agg(pairs).first()[0] or 0)
    keys = ["split", *SESSION]
    if normalize:
        items = items.join(session_sizes(items, parts), keys)
        weight = F.lit(1.0) / (F.col("session_size") - 1)
        carried = ["session_size"]
    else:
        weight = F.lit(1.0)
        carried = []
    some_large = not large.isEmpty()
    small_items = items.join(large.select(*keys), keys, "left_anti") if some_large else items
    small_items = small_items.repartition(parts, *keys)
    left = small_items.withColumnRenamed("item_id", "item_a")
    right = small_items.select(*keys, F.col("item_id").alias("item_b"))
    pairs = (
        left.join(right, keys)
        .where(F.col("item_a") < F.col("item_b"))
        .select("split", *PAIR, weight.alias("pair_weight"))
    )
    if not some_large:
        return pairs, bound
    return pairs.unionByName(_blocked_pairs(items, large, keys, carried, weight, block_items)), bound


def _blocked_pairs(
    items: DataFrame, large: DataFrame, keys: list[str], carried: list[str], weight: Column, block_items: int
) -> DataFrame:
    n_blocks = F.ceil(F.col("session_size") / F.lit(block_items)).cast("int")
    large_items = items.drop("session_size").join(large, keys).select(
        *keys,
        "item_id",
        *carried,
        n_blocks.alias("n_blocks"),
        F.pmod(F.xxhash64("item_id"), n_blocks).cast("int").alias("block"),
    )
    left = large_items.select(
        *keys,
        *carried,
        F.col("item_id").alias("left_item"),
        F.col("block").alias("low"),
        F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("high"),
    )
    right = large_items.select(
        *keys,
        F.col("item_id").alias("right_item"),
        F.col("block").alias("high"),
        F.explode(F.sequence(F.lit(0), "block")).alias("low"),
    )
    once = (F.col("low") < F.col("high")) | (F.col("left_item") < F.col("right_item"))
    return (
        left.join(right, [*keys, "low", "high"])
        .where(once)
        .select(
            "split",
            F.least("left_item", "right_item").alias("item_a"),
            F.greatest("left_item", "right_item").alias("item_b"),
            weight.alias("pair_weight"),
        )
    )


def co_view_edges(
    session_views: DataFrame, normalize: bool = False, min_weight: float | None = None, block_items: int = 4096
) -> DataFrame:
    """(split, item_a, item_b, weight, raw_count); all splits in one pass over the views.

    Pairs are dealt to as many tasks as a bound on their number asks for, and summed there.
    """
    pairs, bound = _pairs_and_bound(session_views, normalize, block_items)
    parts = partitions_for(pairs.sparkSession, bound, PAIRS_PER_TASK)
    edges = pairs.repartition(parts, "split", *PAIR).groupBy("split", *PAIR).agg(
        F.sum("pair_weight").alias("weight"), F.count("*").alias("raw_count")
    )
    return edges if min_weight is None else edges.where(F.col("weight") >= min_weight)


def edges_of(edges: DataFrame, split: str) -> DataFrame:
    return edges.where(F.col("split") == split).drop("split")


def remove_known_pairs(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose pair is not in `known`."""
    return edges.join(known.select(*PAIR), PAIR, "left_anti")


def shared_held_out_pairs(held_out: DataFrame) -> DataFrame:
    """One row: val pairs, test pairs, and pairs that are in both."""
    sides = held_out.groupBy(*PAIR).agg(
        *[F.max(F.col("split") == name).alias(name) for name in ("val", "test")]
    )
    return sides.agg(
        F.count_if("val").alias("val_pairs"),
        F.count_if("test").alias("test_pairs"),
        F.count_if(F.col("val") & F.col("test")).alias("shared_pairs"),
    )


def held_out_edges(edges: DataFrame) -> DataFrame:
    """All train edges, plus the val and test edges whose pair is not a train edge."""
    train = edges.where(F.col("split") == "train")
    others = edges.where(F.col("split") != "train")
    return train.unionByName(remove_known_pairs(others, train))


def graph_nodes(*edge_tables: DataFrame) -> DataFrame:
    """Distinct item_id over both ends of all edge tables."""
    ends = [e.select(F.explode(F.array(*PAIR)).alias("item_id")) for e in edge_tables]
    return reduce(DataFrame.unionByName, ends).distinct()


def count_nodes(edges: DataFrame) -> DataFrame:
    """One row: n_nodes."""
    return graph_nodes(edges).agg(F.count("*").alias("n_nodes"))


def remap_edges(edges: DataFrame, node_index: DataFrame, parts: int | None = None) -> DataFrame:
    """Add src and dst, the node indices of the pair; null where an end is not in `node_index`.

    With `parts`, both joins are dealt to so many tasks.
    """
    first = node_index.select(F.col("item_id").alias("item_a"), F.col("node_idx").alias("src"))
    second = node_index.select(F.col("item_id").alias("item_b"), F.col("node_idx").alias("dst"))
    if parts is None:
        return edges.join(first, "item_a", "left").join(second, "item_b", "left")
    found = edges.repartition(parts, "item_a").join(first.repartition(parts, "item_a"), "item_a", "left")
    return found.repartition(parts, "item_b").join(second.repartition(parts, "item_b"), "item_b", "left")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """src and dst swapped, other columns kept."""
    swapped = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(swapped.get(c, c)).alias(c) for c in edges.columns])


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Each edge in both directions with the same weight, nothing removed."""
    return edges.unionByName(reversed_edges(edges))


def to_undirected(edges: DataFrame) -> DataFrame:
    return symmetric_edges(edges.select("src", "dst"))


def unique_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct()


def with_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges plus one loop per row of `nodes` (node_idx)."""
    loops = nodes.select(F.col("node_idx").alias("src"), F.col("node_idx").alias("dst"))
    return edges.select("src", "dst").unionByName(loops).distinct()


def canonical_pair(edges: DataFrame) -> DataFrame:
    """Add lo and hi, the two ends in ascending order; kept as columns, so nothing can overflow."""
    return edges.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))


def mask_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Graph edges without the pairs in `removed`, whatever the direction of either."""
    gone = canonical_pair(removed.select("src", "dst")).select("lo", "hi").distinct()
    return canonical_pair(edges).join(gone, ["lo", "hi"], "left_anti").drop("lo", "hi")


def add_edges(edges: DataFrame, extra: DataFrame) -> DataFrame:
    """Graph edges followed by `extra` in both directions (duplicates kept)."""
    return edges.select("src", "dst").unionByName(to_undirected(extra))


def node_features(node_index: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(node_idx, item_id, vector): the item's vector, or zeros where there is none."""
    known = vectors.select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    return node_index.join(known, "item_id", "left").withColumn(
        "vector", F.coalesce("vector", zeros(dim))
    ).select("node_idx", "item_id", "vector")


def graph_summary(edges: DataFrame, labels: DataFrame, dim: int) -> DataFrame:
    """Long-form (metric, split, value): nodes, features, edges and labelled pairs per split."""
    nodes = graph_nodes(edges).agg(F.count("*").cast("double").alias("value")).select(
        F.lit("nodes").alias("metric"), F.lit("all").alias("split"), "value"
    )
    features = nodes.select(
        F.lit("features").alias("metric"), "split", F.lit(float(dim)).alias("value")
    )
    per_split = edges.groupBy("split").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("edges").alias("metric"), "split", "value"
    )
    kind = F.when(F.col("is_positive"), "positive_pairs").otherwise("negative_pairs")
    pairs = labels.groupBy(kind.alias("metric"), "split").agg(F.count("*").cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [nodes, features, per_split, pairs])
