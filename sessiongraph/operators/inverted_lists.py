"""Top-k search through inverted lists: a calibrated number of lists per query, or as many as the bounds demand."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessiongraph.functions.blocks import Tiles, improve, matrix, no_best
from sessiongraph.functions.vectors import unit
from sessiongraph.operators.retrieval import (
    POOL_BLOCK,
    POOL_SQUARE,
    QUERY_BLOCK,
    QUERY_SQUARE,
    QUERY_TILE,
    keep_best,
    per_trigger,
    queries_and_pool,
    top_k_by_group,
)
from sessiongraph.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: fewest items per list.
MIN_POINTS_PER_LIST = 39
# Items per list that the centers are trained on; all items are assigned.
TRAINED_PER_LIST = 256
# Queries per category that the number of probed lists is calibrated on, and the recall it is set for.
CALIBRATION_QUERIES = 200
DEFAULT_RECALL = 0.95
_SUMS = pa.schema(
    [("category", pa.string()), ("list_id", pa.int64()), ("total", pa.list_(pa.float64())), ("n", pa.int64())]
)
# Bounds are compared with this slack, so that rounding cannot close a list that holds a best item.
SLACK = 1e-9


def list_count_column(size: Column) -> Column:
    """Number of inverted lists for a pool: about 4 sqrt(n), with at least 39 items per list."""
    per_points = F.floor(size / F.lit(MIN_POINTS_PER_LIST))
    return F.greatest(F.lit(1), F.least(per_points, F.floor(F.lit(4) * F.sqrt(size)))).cast("long")


def member_sums(members: pa.Table, centers: pa.Table) -> pa.Table:
    """Cogroup of a block of items with all centers: the sum and number of the items nearest to each center."""
    if not (members.num_rows and centers.num_rows):
        return pa.table({"category": [], "list_id": [], "total": [], "n": []}, schema=_SUMS)
    items, points = matrix(members["vector"]), matrix(centers["center"])
    nearest = (items @ points.T).argmax(axis=1)
    order = np.argsort(nearest, kind="stable")
    used, first, n = np.unique(nearest[order], return_index=True, return_counts=True)
    totals = np.add.reduceat(items[order], first, axis=0)
    label = members["category"][0].as_py()
    return pa.table(
        {
            "category": [label] * len(used),
            "list_id": centers["list_id"].to_numpy()[used],
            "total": list(totals),
            "n": n,
        },
        schema=_SUMS,
    )


def assigned(members: pa.Table, centers: pa.Table) -> pa.Table:
    """Cogroup of a block of items with all centers: each item with its nearest list and the cosine to its center."""
    ids, best = np.empty(0, dtype=np.int64), np.empty(0)
    if members.num_rows and centers.num_rows:
        cosines = matrix(members["vector"]) @ matrix(centers["center"]).T
        nearest = cosines.argmax(axis=1)
        ids, best = centers["list_id"].to_numpy()[nearest], cosines.max(axis=1)
    else:
        members = members.slice(0, 0)
    return pa.table(
        {
            "category": members["category"],
            "item_id": members["item_id"],
            "list_id": pa.array(ids, type=pa.int64()),
            "cosine": pa.array(best, type=pa.float64()),
            "vector": members["vector"],
        }
    )


def chosen_lists(queries: pa.Table, lists: pa.Table) -> pa.Table:
    """Cogroup of a block of queries with all lists: the lists each query has to look into.

    `probes` is the number of nearest lists. With `least`, the score to beat, it is the lists beyond these that may
    hold an item of that score: an item of a list is within the list's angle `reach` of the center, so its score is
    at most the cosine of the angle between query and center less `reach`.
    """
    rows = columns = places = np.empty(0, dtype=np.int64)
    if queries.num_rows and lists.num_rows:
        cosines = matrix(queries["vector"]) @ matrix(lists["center"]).T
        order = np.argsort(-cosines, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        near = place < queries["probes"].to_numpy()[:, None]
        least = queries["least"].to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
        within = best_possible(cosines, lists["reach"].to_numpy()) >= least - SLACK
        rows, columns = np.nonzero(np.where(np.isnan(least), near, within & ~near))
        places = place[rows, columns]
    taken = queries.take(pa.array(rows, type=pa.int64()))
    return pa.table(
        {
            "category": taken["category"],
            "query_id": taken["query_id"],
            "list_id": pa.array(lists["list_id"].to_numpy()[columns], type=pa.int64()),
            "place": pa.array(places, type=pa.int64()),
        }
    )


def cutoffs(queries: pa.Table, lists: pa.Table) -> pa.Table:
    """Cogroup of a block of queries with all lists: the cosine of each query to the farthest of its `probes` lists."""
    cut = np.empty(0)
    if queries.num_rows and lists.num_rows:
        cosines = -matrix(queries["vector"]) @ matrix(lists["center"]).T
        cosines.sort(axis=1)
        probes = np.clip(queries["probes"].to_numpy(), 1, cosines.shape[1])
        cut = -cosines[np.arange(len(cosines)), probes - 1]
    else:
        queries = queries.slice(0, 0)
    return pa.table(
        {
            "category": queries["category"],
            "query_id": queries["query_id"],
            "vector": queries["vector"],
            "cutoff": pa.array(cut, type=pa.float64()),
        }
    )


def best_possible(cosines: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The highest score that an item of a list can have: it lies within the angle `reach` of the list's center."""
    angle = np.arccos(np.clip(cosines, -1, 1)) - reach
    return np.cos(np.maximum(angle, 0))


def shelf_best(
    queries: np.ndarray,
    query_ids: np.ndarray,
    cutoff: np.ndarray,
    least: np.ndarray,
    centers: np.ndarray,
    reach: np.ndarray,
    members: list[tuple[np.ndarray, np.ndarray]],
    k: int,
    query_tile: int,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, scores computed): the k best items of each query among the lists it looks into.

    `members` are the vectors and ascending ids of each list. A query looks into the lists whose center has at least the
    cosine `cutoff`, and of these only into those whose best possible score is not below `least` or the k-th score so
    far, so what is left out cannot be among the k best.
    """
    scores, ids = no_best(len(queries), k)
    computed = 0
    for rows in Tiles(queries, query_tile).rows:
        asked = queries[rows]
        cosines = asked @ centers.T
        bounds = np.where(cosines >= cutoff[rows, None] - SLACK, best_possible(cosines, reach), -np.inf)
        bounds[bounds < least[rows, None] - SLACK] = -np.inf
        best = scores[rows], ids[rows]
        room = np.full(len(rows), SLACK)
        for place in np.argsort(-bounds.max(axis=0), kind="stable"):
            bound = bounds[:, place]
            opened = np.flatnonzero((bound > -np.inf) & (bound >= best[0][:, -1] - SLACK))
            vectors, named = members[place]
            if not (len(opened) and len(named)):
                continue
            computed += len(opened) * len(named)
            improve(best, opened, asked[opened] @ vectors.T, query_ids[rows], named, k, room)
        scores[rows], ids[rows] = best
    return scores, ids, computed


def shelf_scorer(k: int, query_tile: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A cogroup function: `shelf_best` of a block of queries with the lists of one shelf.

    The shelf holds rows of both kinds: centers with their `reach`, and members with their `item_id`.
    """

    def score(queries: pa.Table, shelf: pa.Table) -> pa.Table:
        query_ids = item_ids = np.empty(0, dtype=np.int64)
        scores = np.empty(0)
        label = None
        # A shelf at the end of a long list may have got no item.
        if queries.num_rows and shelf["item_id"].null_count < shelf.num_rows:
            label = queries["category"][0].as_py()
            is_center = shelf["item_id"].is_null()
            lists = shelf.filter(is_center)
            items = shelf.filter(pa.compute.invert(is_center)).sort_by([("list_id", "ascending"), ("item_id", "ascending")])
            vectors, named, of_list = matrix(items["item_vector"]), items["item_id"].to_numpy(), items["list_id"].to_numpy()
            wanted = lists["list_id"].to_numpy()
            low, high = np.searchsorted(of_list, wanted), np.searchsorted(of_list, wanted, "right")
            asked = queries["query_id"].to_numpy()
            best, ids, _ = shelf_best(
                matrix(queries["vector"]),
                asked,
                queries["cutoff"].to_numpy(),
                queries["least"].to_numpy(),
                matrix(lists["item_vector"]),
                lists["reach"].to_numpy(),
                [(vectors[a:b], named[a:b]) for a, b in zip(low, high, strict=True)],
                k,
                query_tile,
            )
            rows, columns = np.nonzero(np.isfinite(best))
            query_ids, item_ids, scores = asked[rows], ids[rows, columns], best[rows, columns]
        return pa.table(
            {
                "category": pa.array([label] * len(scores), type=pa.string()),
                "query_id": pa.array(query_ids, type=pa.int64()),
                "item_id": pa.array(item_ids, type=pa.int64()),
                "score": pa.array(scores, type=pa.float64()),
            }
        )

    return score


def _with_all(rows: DataFrame, others: DataFrame, function: Callable, schema: str) -> DataFrame:
    """`function` on each (category, block) of `rows` with all `others` of the category.

    `rows` holds `block` and `blocks`, numbers of bounded blocks per category; `others` are a few per root of the items.
    """
    blocks = rows.groupBy("category").agg(F.max("blocks").alias("_blocks"))
    copies = others.join(blocks, "category").select(
        F.col("category").alias("of_category"),
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("of_block"),
        *[c for c in others.columns if c != "category"],
    )
    return rows.groupBy("category", "block").cogroup(copies.groupBy("of_category", "of_block")).applyInArrow(
        function, schema
    )


def _blocked(rows: DataFrame, id_column: str, rows_per_block: int) -> DataFrame:
    """`rows` with a hashed block number of bounded size within the category, stored."""
    sizes = rows.groupBy("category").agg(F.ceil(F.count("*") / F.lit(rows_per_block)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64(id_column), F.col("blocks")).cast("int").alias("block")
    return materialize(rows.join(sizes, "category").select(*rows.columns, "blocks", block), "blocked")


def _fewest(rows: DataFrame, wanted: Column, size: Column, id_column: str, seed: int) -> DataFrame:
    """About the first `wanted` rows of each category in hash order, numbered by `place` from 0.

    Twice the share that should be enough is taken before the window, so it never sorts a whole category.
    """
    share = F.pmod(F.xxhash64(id_column, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.withColumn("_share", share).where(F.col("_share") * size <= 2 * wanted + 20)
    order = Window.partitionBy("category").orderBy("_share", id_column)
    return some.withColumn("place", F.row_number().over(order).cast("long") - 1).where(F.col("place") < wanted)


def train_lists(pool: DataFrame, iterations: int = 5, seed: int = 42) -> DataFrame:
    """(category, list_id, center) by spherical k-means of all categories at once, stored.

    `pool` is stored (category, item_id, vector). Centers are trained on at most about `TRAINED_PER_LIST` items per
    list, the first ones in hash order; the first of them are the start. A round gives each block of items all centers
    of its category and returns sums per list, so no vector is joined back.
    """
    size = pool.groupBy("category").agg(F.count("*").alias("size"))
    sizes = materialize(size.withColumn("lists", list_count_column(F.col("size"))), "pool_sizes")
    sized = pool.join(sizes, "category")
    sample = _fewest(sized, F.col("lists") * TRAINED_PER_LIST, F.col("size"), "item_id", seed)
    sample = _blocked(sample.select("category", "item_id", "vector", "place", "lists"), "item_id", POOL_BLOCK)
    centers = materialize(
        sample.where(F.col("place") < F.col("lists")).select(
            "category", F.col("place").alias("list_id"), F.col("vector").alias("center")
        ),
        "centers",
    )
    for _ in range(iterations):
        sums = _with_all(
            sample, centers, member_sums, "category string, list_id long, total array<double>, n long"
        )
        means = sums.groupBy("category", "list_id").agg(Summarizer.sum(array_to_vector("total")).alias("sum"))
        centers = materialize(
            means.select("category", "list_id", unit(vector_to_array("sum")).alias("center")), "centers"
        )
    return centers


def build_lists(pool: DataFrame, iterations: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(members, lists), stored: (category, item_id, list_id, cosine, vector) and (category, list_id, center, reach,
    size, start).

    `reach` is the largest angle between a list's center and its items, `start` the number of items in the category's
    lists before it.
    """
    centers = train_lists(pool, iterations, seed)
    members = materialize(
        _with_all(
            _blocked(pool, "item_id", POOL_BLOCK),
            centers,
            assigned,
            "category string, item_id long, list_id long, cosine double, vector array<double>",
        ),
        "members",
    )
    widest = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("cosine")))
    shapes = members.groupBy("category", "list_id").agg(F.acos(widest).alias("reach"), F.count("*").alias("size"))
    before = Window.partitionBy("category").orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1)
    lists = centers.join(shapes, ["category", "list_id"])
    return members, materialize(
        lists.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))), "lists"
    )


def calibrated_probes(
    queries: DataFrame, pool: DataFrame, members: DataFrame, lists: DataFrame, k: int, recall: float, seed: int = 42
) -> DataFrame:
    """(category, probes): the fewest nearest lists that hold `recall` of the exact k best of some sampled queries."""
    sizes = queries.groupBy("category").agg(F.count("*").alias("size"))
    asked = _fewest(queries.join(sizes, "category"), F.lit(CALIBRATION_QUERIES), F.col("size"), "query_id", seed)
    asked = materialize(asked.select("category", "query_id", "vector"), "calibration")
    best = top_k_by_group(asked, pool, "category", k).select("category", "query_id", "item_id")
    held = best.join(members.select("category", "item_id", "list_id"), ["category", "item_id"])
    places = _choose(asked.withColumn("probes", F.lit(1 << 30)).withColumn("least", F.lit(None).cast("double")), lists)
    ranked = held.join(places.select("category", "query_id", "list_id", "place"), ["category", "query_id", "list_id"])
    needed = F.expr(f"percentile_disc({recall}) within group (order by place)")
    return ranked.groupBy("category").agg((needed + 1).cast("int").alias("probes"))


def _choose(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """`chosen_lists` of (category, query_id, vector, probes, least) rows: a row per query and list."""
    return _with_all(
        _blocked(queries, "query_id", QUERY_BLOCK),
        lists,
        chosen_lists,
        "category string, query_id long, list_id long, place long",
    )


def _cut(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """(category, query_id, vector, cutoff) of (category, query_id, vector, probes) rows, one row per query."""
    return _with_all(
        _blocked(queries, "query_id", QUERY_BLOCK),
        lists,
        cutoffs,
        "category string, query_id long, vector array<double>, cutoff double",
    )


def _search(
    queries: DataFrame,
    members: DataFrame,
    lists: DataFrame,
    k: int,
    query_square: int = QUERY_SQUARE,
    pool_square: int = POOL_SQUARE,
) -> DataFrame:
    """(category, query_id, item_id, score) of the best items of `shelf_best`, k per query and shelf.

    `queries` are (category, query_id, vector, cutoff, least). The lists of a category stand one after the other on
    shelves of about `pool_square` items; a longer list goes over several. A block of queries meets a shelf in one
    task, which finds out itself who looks into which list. So a vector travels once per block of the other side, as in
    the exact search, and not once per list.
    """
    blocks = queries.groupBy("category").agg(F.ceil(F.count("*") / F.lit(query_square)).cast("int").alias("query_blocks"))
    shelves = lists.groupBy("category").agg(
        (F.floor((F.max(F.col("start") + F.col("size")) - 1) / F.lit(pool_square)) + 1).cast("int").alias("shelves")
    )
    shape = materialize(blocks.join(shelves, "category"), "shelf_counts")
    query_side = queries.join(shape, "category").select(
        "category",
        "query_id",
        "vector",
        "cutoff",
        "least",
        F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.col("shelves") - 1)).alias("shelf"),
    )

    def shelf(place: Column) -> Column:
        return F.floor(place / F.lit(pool_square)).cast("int")

    # A member's place is drawn by hash within its list.
    drawn = F.col("start") + F.pmod(F.xxhash64("item_id"), F.col("size"))
    placed = members.join(lists.select("category", "list_id", "start", "size"), ["category", "list_id"]).select(
        "category",
        "list_id",
        shelf(drawn).alias("of_shelf"),
        "item_id",
        F.lit(None).cast("double").alias("reach"),
        F.col("vector").alias("item_vector"),
    )
    spans = F.sequence(shelf(F.col("start")), shelf(F.col("start") + F.col("size") - 1))
    headed = lists.select(
        "category",
        "list_id",
        F.explode(spans).alias("of_shelf"),
        F.lit(None).cast("long").alias("item_id"),
        "reach",
        F.col("center").alias("item_vector"),
    )
    shelf_side = placed.unionByName(headed).join(shape, "category").select(
        F.col("category").alias("of_category"),
        "list_id",
        "of_shelf",
        "item_id",
        "reach",
        "item_vector",
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("of_query_block"),
    )
    return (
        query_side.groupBy("category", "query_block", "shelf")
        .cogroup(shelf_side.groupBy("of_category", "of_query_block", "of_shelf"))
        .applyInArrow(
            shelf_scorer(k, QUERY_TILE), "category string, query_id bigint, item_id bigint, score double"
        )
    )


def approximate_top_k(
    triggers: DataFrame,
    pool: DataFrame,
    vectors: DataFrame,
    k: int,
    probes: int | None = None,
    recall: float = DEFAULT_RECALL,
    bounded: bool = False,
    iterations: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Cosine top-k within the trigger's category from the nearest inverted lists: (split, exec_code, item_id, score, rank).

    `probes` lists are looked into per query (and those as near as the last of them); without it, as many per category
    as hold `recall` of the exact answers to a bounded sample of queries. With `bounded`, that gives the score to beat:
    then every list whose best possible score is not below it is looked into, which makes the answer exact; how many
    that are depends on how well the vectors fall into lists.
    """
    queries, candidates = queries_and_pool(triggers, pool, vectors)
    candidates = materialize(candidates, "pool_vectors")
    queries = materialize(queries, "query_vectors")
    members, lists = build_lists(candidates, iterations, seed)
    if probes is None:
        wanted = materialize(calibrated_probes(queries, candidates, members, lists, k, recall, seed), "probes")
        asked = queries.join(wanted, "category")
    else:
        asked = queries.withColumn("probes", F.lit(min(probes, 1 << 30)))
    ids = ["category", "query_id"]
    nothing = F.lit(-2.0)
    found = keep_best(_search(_cut(asked, lists).withColumn("least", nothing), members, lists, k), ids, k)
    if bounded:
        found = materialize(found, "found")
        kth = found.where(F.col("rank") == k).select(*ids, F.col("score").alias("least"))
        # A query with fewer than k items so far has no score to beat: all lists are open to it.
        open_to = queries.join(kth, ids, "left").select(
            *ids, "vector", nothing.alias("cutoff"), F.coalesce("least", nothing).alias("least")
        )
        found = keep_best(_search(open_to, members, lists, k), ids, k)
    return per_trigger(triggers, found)
