"""Registered queries: co-view graph, node index, features, propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.operators import coview, index, propagation
from sessiongraph.plans.registry import Run, query
from sessiongraph.session import partitions_for


def _train_indexed(c: Run) -> DataFrame:
    return coview.remap_edges(c.train_edges, c.node_index).select("src", "dst", "weight")


def _symmetric(c: Run) -> DataFrame:
    return coview.symmetric_edges(_train_indexed(c))


def _label_edges(c: Run, split: str) -> DataFrame:
    chosen = (F.col("split") == split) & F.col("is_positive")
    return c.pairs.where(chosen).select("src", "dst")


def _cells(nodes: DataFrame) -> DataFrame:
    """Vectors as (node_idx, dim, x) rows."""
    return nodes.select("node_idx", F.posexplode("vector").alias("dim", "x")).select(
        "node_idx", F.col("dim").cast("long").alias("dim"), "x"
    )


@query("e1_session_items", "select split, user_id, session_id, item_id from g_basket_items")
def _(c: Run) -> DataFrame:
    return coview.session_items(c.baskets)


@query(
    "e2_session_sizes",
    "select split, user_id, session_id, count(*) as session_size from g_basket_items group by all",
)
def _(c: Run) -> DataFrame:
    parts = partitions_for(c.spark, c.baskets.count())
    return coview.session_sizes(coview.session_items(c.baskets, parts), parts)


_BASKET_PAIRS = """from g_basket_items a join g_basket_items b on a.user_id = b.user_id
    and a.session_id = b.session_id and a.split = b.split and a.item_id < b.item_id"""


@query(
    "e3_session_pairs",
    f"select a.split, a.item_id as item_a, b.item_id as item_b, 1.0::double as pair_weight {_BASKET_PAIRS}",
)
def _(c: Run) -> DataFrame:
    return coview.session_pairs(c.baskets)


@query(
    "e3_session_pairs_long_sessions",
    f"select a.split, a.item_id as item_a, b.item_id as item_b, 1.0::double as pair_weight {_BASKET_PAIRS}",
)
def _(c: Run) -> DataFrame:
    """The block way of long sessions, here for every session above three items."""
    return coview.session_pairs(c.baskets, block_items=3)


@query(
    "e4_normalized_weights",
    f"""select a.split, a.item_id as item_a, b.item_id as item_b,
               round(sum(1.0::double / (s.n - 1)), 6) as weight, count(*) as raw_count {_BASKET_PAIRS}
        join (select user_id, session_id, count(*) as n from g_basket_items group by all) s
             on s.user_id = a.user_id and s.session_id = a.session_id group by all""",
)
def _(c: Run) -> DataFrame:
    return coview.co_view_edges(c.baskets, normalize=True)


@query(
    "e5_co_view_edges",
    f"""select a.split, a.item_id as item_a, b.item_id as item_b, count(*)::double as weight,
               count(*) as raw_count {_BASKET_PAIRS} group by all""",
)
def _(c: Run) -> DataFrame:
    return coview.co_view_edges(c.baskets)


@query(
    "e5_co_view_edges_min_weight",
    "select split, item_a, item_b, weight, raw_count from g_edges where weight >= 2",
)
def _(c: Run) -> DataFrame:
    return coview.co_view_edges(c.session_views, min_weight=2)


@query(
    "e6_held_out_edges",
    """select split, item_a, item_b, weight, raw_count from g_edges e where split = 'train' or not exists
       (select 1 from g_train t where t.item_a = e.item_a and t.item_b = e.item_b)""",
)
def _(c: Run) -> DataFrame:
    return coview.held_out_edges(c.edges)


@query(
    "t21_shared_held_out_pairs",
    """select count(*) filter (where split = 'val') as val_pairs, count(*) filter (where split = 'test') as test_pairs,
              count(*) - count(distinct (item_a, item_b)) as shared_pairs
       from (select e.split, e.item_a, e.item_b from
               (select distinct split, item_a, item_b from g_baskets_pairs where split <> 'train') e
             where not exists (select 1 from g_baskets_pairs t where t.split = 'train' and t.item_a = e.item_a
                               and t.item_b = e.item_b))""",
)
def _(c: Run) -> DataFrame:
    """On the baskets, whose graph grows with the folder."""
    held = coview.held_out_edges(coview.co_view_edges(c.baskets)).where(F.col("split") != "train")
    return coview.shared_held_out_pairs(held)


@query(
    "e7_count_nodes",
    "select count(*) as n_nodes from (select item_a from g_train union select item_b from g_train)",
)
def _(c: Run) -> DataFrame:
    return coview.count_nodes(c.train_edges)


@query("e8_graph_nodes", "select item_id from g_nodes")
def _(c: Run) -> DataFrame:
    splits = [coview.edges_of(c.edges, s) for s in ("train", "val", "test")]
    return coview.graph_nodes(*splits)


@query(
    "e9_dense_node_index",
    """select item_id, row_number() over (order by item_id) - 1 as node_idx
       from (select distinct item_id from g_basket_items)""",
)
def _(c: Run) -> DataFrame:
    return index.dense_index(c.baskets, "item_id", "node_idx")


@query(
    "e10_remap_edges",
    """select t.item_a, t.item_b, a.node_idx as src, b.node_idx as dst from g_edges t
       left join (select * from g_nidx where item_id in (select item_a from g_train)) a on a.item_id = t.item_a
       left join (select * from g_nidx where item_id in (select item_a from g_train)) b on b.item_id = t.item_b""",
)
def _(c: Run) -> DataFrame:
    """Only left ends of train edges are indexed here, so some ends stay without a node."""
    left_ends = c.train_edges.select(F.col("item_a").alias("item_id")).distinct()
    partial = c.node_index.join(left_ends, "item_id", "left_semi")
    return coview.remap_edges(c.edges, partial).select("item_a", "item_b", "src", "dst")


@query("e11_symmetric_edges", "select src, dst, weight from g_sym")
def _(c: Run) -> DataFrame:
    return _symmetric(c)


@query(
    "e12_to_undirected",
    "select src, dst from g_train_idx union all select dst, src from g_train_idx",
)
def _(c: Run) -> DataFrame:
    return coview.to_undirected(_train_indexed(c))


@query("e13_unique_edges", "select distinct src, dst from g_pairs")
def _(c: Run) -> DataFrame:
    return coview.unique_edges(c.pairs)


@query("e14_without_self_loops", "select distinct src, dst from g_pairs where src <> dst")
def _(c: Run) -> DataFrame:
    return coview.without_self_loops(c.pairs)


@query("e15_with_self_loops", "select src, dst from g_pairs union select node_idx, node_idx from g_nidx")
def _(c: Run) -> DataFrame:
    return coview.with_self_loops(c.pairs, c.node_index)


@query(
    "e16_canonical_pair",
    "select split, exec_code, src, dst, least(src, dst) as lo, greatest(src, dst) as hi from g_pairs",
)
def _(c: Run) -> DataFrame:
    return coview.canonical_pair(c.pairs).select("split", "exec_code", "src", "dst", "lo", "hi")


@query(
    "e17_mask_label_edges",
    """select src, dst, weight from g_sym e where not exists
       (select 1 from g_pairs p where p.split = 'train' and p.is_positive
        and least(p.src, p.dst) = least(e.src, e.dst) and greatest(p.src, p.dst) = greatest(e.src, e.dst))""",
)
def _(c: Run) -> DataFrame:
    return coview.mask_edges(_symmetric(c), _label_edges(c, "train"))


@query(
    "e18_add_val_edges",
    """select src, dst from g_sym
       union all select src, dst from g_pairs where split = 'val' and is_positive
       union all select dst, src from g_pairs where split = 'val' and is_positive""",
)
def _(c: Run) -> DataFrame:
    return coview.add_edges(_symmetric(c), _label_edges(c, "val"))


@query("e19_node_features", "select node_idx, dim, round(x, 6) as x from g_cells")
def _(c: Run) -> DataFrame:
    return _cells(coview.node_features(c.node_index, c.vectors, c.settings.vector_dim))


@query(
    "e20_graph_summary",
    """select 'nodes' as metric, 'all' as split, count(*)::double as value from g_nodes
       union all select 'features', 'all', 64.0
       union all select 'edges', split, count(*)::double from g_edges group by split
       union all select case when is_positive then 'positive_pairs' else 'negative_pairs' end, split,
                        count(*)::double from g_pairs group by all""",
)
def _(c: Run) -> DataFrame:
    return coview.graph_summary(c.edges, c.pairs, c.settings.vector_dim)


@query("i1_normalized_sum", "select node_idx, dim, round(x, 6) as x from g_hop1")
def _(c: Run) -> DataFrame:
    return _cells(propagation.normalized_sum(_symmetric(c), c.features))


@query(
    "i2_neighbor_mean",
    """select e.dst as node_idx, x.dim, round(avg(x.x), 6) as x from g_sym e
       join g_cells x on x.node_idx = e.src group by all""",
)
def _(c: Run) -> DataFrame:
    return _cells(propagation.neighbor_mean(_symmetric(c), c.features))


@query("i3_two_hops", "select node_idx, dim, round(x, 6) as x from g_hop2")
def _(c: Run) -> DataFrame:
    return _cells(propagation.propagate(_symmetric(c), c.features, hops=2))


def _nonzero_cells(vectors: DataFrame) -> DataFrame:
    cells = vectors.select("node_idx", F.posexplode("vector").alias("dim", "x"))
    return cells.where(F.col("x") != 0)


def _basket_graph(c: Run) -> DataFrame:
    return coview.symmetric_edges(c.basket_edges.select("src", "dst"))


@query("i1_normalized_sum_of_baskets", "select node_idx, dim, round(x, 6) as x from g_basket_hop1")
def _(c: Run) -> DataFrame:
    """Over the items of all orders, whose number grows with the folder."""
    return _nonzero_cells(propagation.normalized_sum(_basket_graph(c), c.basket_features))


@query(
    "i2_neighbor_mean_of_baskets",
    """select dst as node_idx, dim, round(sum(x) / degree, 6) as x
       from (select s.dst, s.src, count(*) over (partition by s.dst) as degree from g_basket_sym s) e
       join g_basket_cells c on c.node_idx = e.src group by dst, dim, degree""",
)
def _(c: Run) -> DataFrame:
    return _nonzero_cells(propagation.neighbor_mean(_basket_graph(c), c.basket_features))


@query("i3_two_hops_of_baskets", "select node_idx, dim, round(x, 6) as x from g_basket_hop2")
def _(c: Run) -> DataFrame:
    return _nonzero_cells(propagation.propagate(_basket_graph(c), c.basket_features, hops=2))
