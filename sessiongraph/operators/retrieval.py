"""Top-k items of the trigger's category by vector score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessiongraph.functions import blocks
from sessiongraph.functions.blocks import block_scorer
from sessiongraph.functions.vectors import MIN_NORM, dot, hadamard, unit
from sessiongraph.operators.rankings import (
    by_session_length,
    is_viewed,
    item_ids,
    listed_sessions,
    mark_seen,
    split_by_seen,
)
from sessiongraph.session import materialize

# The block functions travel with the plan, so the executors need no copy of this package.
cloudpickle.register_pickle_by_value(blocks)

MODEL_PRODUCTS = "array<struct<item_id:bigint,score:double,rank:int>>"

# Rows per block of the searches that hold all scores of two blocks: these stay well under 100 MB in a task.
QUERY_BLOCK = 1024
POOL_BLOCK = 4096
# Rows per side of a square of the exact search, and of the tiles in which a task walks it. At 384 components a square
# is some 250 MB as doubles, and a tile of scores 32 MB.
QUERY_SQUARE = 16_384
POOL_SQUARE = 65_536
QUERY_TILE = 1024
POOL_TILE = 4096


def graph_triggers(owners: DataFrame, node_index: DataFrame) -> DataFrame:
    """Triggers (one per execution code) whose item is a node, with its node_idx."""
    nodes = node_index.select(F.col("item_id").alias("trigger_id"), "node_idx")
    return owners.join(nodes, "trigger_id")


def with_category(triggers: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add the category of the trigger item; null where it has none."""
    categories = vectors.select(F.col("item_id").alias("trigger_id"), "category")
    return triggers.join(categories, "trigger_id", "left")


def candidate_pool(triggers: DataFrame, vectors: DataFrame, node_index: DataFrame) -> DataFrame:
    """Distinct (category, item_id): graph items of the categories that occur among the triggers."""
    wanted = triggers.where(F.col("category").isNotNull()).select("category").distinct()
    return (
        vectors.select("category", "item_id")
        .join(wanted, "category", "left_semi")
        .join(node_index.select("item_id"), "item_id", "left_semi")
        .distinct()
    )


def _block(column: str, count: Column) -> Column:
    return F.pmod(F.xxhash64(column), count).cast("int")


def _block_pairs(
    queries: DataFrame, pool: DataFrame, group: str, query_block: int, pool_block: int
) -> tuple[DataFrame, DataFrame]:
    """Queries by (group, query_block, pool_block), pool items by the same under names with `of_`.

    Block counts are stored first, so the vectors meet a table of known size: it is broadcast if small.
    """
    shape = materialize(
        queries.groupBy(group)
        .agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("query_blocks"))
        .join(
            pool.groupBy(group).agg(F.ceil(F.count("*") / F.lit(pool_block)).cast("int").alias("pool_blocks")),
            group,
        ),
        "block_counts",
    )
    query_side = queries.join(shape, group).select(
        group,
        "query_id",
        "vector",
        _block("query_id", F.col("query_blocks")).alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.col("pool_blocks") - 1)).alias("pool_block"),
    )
    # Every column gets a new name: both sides may come from one table, and a cogroup needs to tell them apart.
    pool_side = pool.join(shape, group).select(
        F.col(group).alias("of_group"),
        F.col("item_id").alias("item_id"),
        F.col("vector").alias("item_vector"),
        _block("item_id", F.col("pool_blocks")).alias("of_pool_block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("of_query_block"),
    )
    return query_side, pool_side


def top_k_by_group(
    queries: DataFrame,
    pool: DataFrame,
    group: str,
    k: int,
    exclude_self: bool = True,
    query_block: int = QUERY_SQUARE,
    pool_block: int = POOL_SQUARE,
    normalize: bool = False,
    query_tile: int = QUERY_TILE,
    pool_tile: int = POOL_TILE,
) -> DataFrame:
    """(group, query_id, item_id, score, rank): the k best pool items of each query's group.

    `queries` is (group, query_id, vector) with distinct rows, `pool` is (group, item_id, vector).
    Both sides of a group are hashed into blocks of bounded size, and each pair of blocks, a square, is one task's
    work: a vector is shuffled once per square of its row or column, as it is stored (`normalize` scales it to
    length one inside the task). The task walks the square in tiles and skips those whose bound cannot beat the
    k-th score. It gives out k rows per query, so pairs are never emitted and a group of any size is spread over
    many tasks. Equal scores go to the lower item id.
    """
    query_side, pool_side = _block_pairs(queries, pool, group, query_block, pool_block)
    group_type = queries.schema[group].dataType.simpleString()
    scorer = block_scorer(group, k, exclude_self, MIN_NORM if normalize else None, query_tile, pool_tile)
    partial = (
        query_side.groupBy(group, "query_block", "pool_block")
        .cogroup(pool_side.groupBy("of_group", "of_query_block", "of_pool_block"))
        .applyInArrow(scorer, f"{group} {group_type}, query_id bigint, item_id bigint, score double")
    )
    return keep_best(partial, [group, "query_id"], k)


def keep_best(scored: DataFrame, query: list[str], k: int) -> DataFrame:
    """The k best rows per query with their rank, best score first, then lower item id."""
    best = Window.partitionBy(*query).orderBy(F.col("score").desc(), F.col("item_id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vector", unit(F.col("vector")))


def queries_and_pool(
    triggers: DataFrame, pool: DataFrame, vectors: DataFrame, normalize: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Distinct query vectors of the trigger items and the pool's vectors, unit length unless told not to.

    Vectors that are null or hold null or non-finite components take no part.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    units = vectors.select("item_id", "vector").where(F.coalesce(finite, F.lit(False)))
    if normalize:
        units = unit_vectors(units)
    asked = triggers.where(F.col("category").isNotNull()).select("category", "trigger_id").distinct()
    queries = asked.join(units.withColumnRenamed("item_id", "trigger_id"), "trigger_id").select(
        "category", F.col("trigger_id").alias("query_id"), "vector"
    )
    return queries, pool.join(units, "item_id").select("category", "item_id", "vector")


def per_trigger(triggers: DataFrame, ranked: DataFrame) -> DataFrame:
    """Give each trigger the ranking of its item: (split, exec_code, item_id, score, rank)."""
    by_item = ranked.select("category", F.col("query_id").alias("trigger_id"), "item_id", "score", "rank")
    return triggers.join(by_item, ["category", "trigger_id"]).select(
        "split", "exec_code", "item_id", "score", "rank"
    )


def exact_top_k(triggers: DataFrame, pool: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k within the trigger's category, the trigger item left out.

    Triggers of one item share one search. A trigger without category or with an empty pool gets no rows.
    """
    queries, candidates = queries_and_pool(triggers, pool, vectors, normalize=False)
    return per_trigger(triggers, top_k_by_group(queries, candidates, "category", k, normalize=True))


def linear_top_k(
    triggers: DataFrame,
    pool: DataFrame,
    vectors: DataFrame,
    k: int,
    weights: Sequence[float],
    bias: float = 0.0,
) -> DataFrame:
    """`exact_top_k` under the linear pair score `bias + sum(weights * left * right)`.

    The weights are folded into the query vector, which turns the score into a dot product.
    """
    queries, candidates = queries_and_pool(triggers, pool, vectors, normalize=False)
    weight = F.array(*[F.lit(float(w)) for w in weights])
    weighted = queries.withColumn("vector", hadamard(F.col("vector"), weight))
    ranked = top_k_by_group(weighted, candidates, "category", k)
    return per_trigger(triggers, ranked.withColumn("score", F.col("score") + F.lit(float(bias))))


def _kept_bits(score: Column) -> Column:
    """The column form of `blocks.kept_bits`."""
    scale = F.pow(F.lit(2.0), F.lit(blocks.SCORE_BITS) - F.floor(F.log2(F.abs(score))) - 1)
    return F.when(score == 0, 0.0).otherwise(F.rint(score * scale) / scale)


def pairwise_top_k(triggers: DataFrame, pool: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The same answer by a plain join and a column dot product, as an independent check.

    It looks at as many pairs as the exact search. Both sides are dealt in the same blocks, so a
    category of any size is spread over many tasks, and the k best rows per query of a task are kept
    before anything is shuffled.
    """
    queries, candidates = queries_and_pool(triggers, pool, vectors)
    query_side, pool_side = _block_pairs(queries, candidates, "category", QUERY_BLOCK, POOL_BLOCK)
    same = (
        (F.col("category") == F.col("of_group"))
        & (F.col("query_block") == F.col("of_query_block"))
        & (F.col("pool_block") == F.col("of_pool_block"))
    )
    score = _kept_bits(dot(F.col("vector"), F.col("item_vector"))).alias("score")
    scored = query_side.join(pool_side, same & (F.col("item_id") != F.col("query_id")))
    scored = scored.select("category", "query_id", "item_id", score)
    return per_trigger(triggers, keep_best(scored, ["category", "query_id"], k))


def parity(found: DataFrame, reference: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """One row: checked triggers, triggers with the same item set, mismatching triggers, largest gap."""
    keys = ["split", "exec_code", "rank"]
    both = found.select(*keys, F.col("item_id").alias("found_item"), F.col("score").alias("found_score")).join(
        reference.select(*keys, F.col("item_id").alias("item"), F.col("score").alias("reference_score")),
        keys,
        "full_outer",
    )
    gap = F.abs(F.col("found_score") - F.col("reference_score"))
    per_trigger = both.groupBy("split", "exec_code").agg(
        F.max(F.coalesce(gap, F.lit(float("inf")))).alias("gap"),
        F.sort_array(F.collect_set("found_item")).alias("found_items"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    return per_trigger.agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("found_items") == F.col("items")).alias("same_ids"),
        F.count_if(F.col("gap") > tolerance).alias("mismatches"),
        F.max("gap").alias("max_gap"),
    )


def check_against_pairwise(
    found: DataFrame,
    triggers: DataFrame,
    pool: DataFrame,
    vectors: DataFrame,
    k: int,
    tolerance: float = 1e-5,
) -> DataFrame:
    """`parity` of a retrieval result on all triggers that have a category."""
    asked = triggers.where(F.col("category").isNotNull())
    checked = found.join(asked.select("split", "exec_code"), ["split", "exec_code"], "left_semi")
    return parity(checked, pairwise_top_k(asked, pool, vectors, k), tolerance)


def recall_against_exact(triggers: DataFrame, found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: mean share of the exact items found; a trigger without an exact answer counts one."""
    keys = ["split", "exec_code"]
    hit = found.select(*keys, "item_id", F.lit(1).alias("hit"))
    share = (
        exact.select(*keys, "item_id")
        .join(hit, [*keys, "item_id"], "left")
        .groupBy(*keys)
        .agg((F.count("hit") / F.count("*")).alias("share"))
    )
    recalls = triggers.select(*keys).join(share, keys, "left").select(
        F.coalesce("share", F.lit(1.0)).alias("share")
    )
    return recalls.agg(
        F.coalesce(F.avg("share"), F.lit(1.0)).alias("mean_recall"),
        F.count_if(F.col("share") < 1.0).alias("below_one"),
        F.count("*").alias("triggers"),
    )


def model_results(
    triggers: DataFrame, rows: DataFrame, items: DataFrame, listed: DataFrame | None = None
) -> DataFrame:
    """One row per graph trigger: products_returned, positives, negatives, each with score and rank.

    Triggers without an answer stay, with empty lists. Lists hold at most k entries. `listed` comes from
    `rankings.listed_sessions` if it is at hand; items of longer sessions are joined.
    """
    keys = ["split", "exec_code", "trigger_id"]
    session = ["user_id", "session_id"]
    entry = F.when(F.col("item_id").isNotNull(), F.struct("rank", "item_id", "score", "seen"))
    short, long = by_session_length(
        triggers.select(*keys, *session), listed_sessions(items) if listed is None else listed
    )
    inside = short.join(rows, ["split", "exec_code"], "left").withColumn("seen", is_viewed(F.col("item_id")))
    looked_up = mark_seen(long.join(rows, ["split", "exec_code"], "left"), items)
    nested = reduce(
        DataFrame.unionByName,
        [
            part.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("listed"))
            for part in (inside, looked_up)
        ],
    )
    every, seen, unseen = split_by_seen(F.col("listed"), ["item_id", "score", "rank"])
    return nested.select(
        *keys,
        every.cast(MODEL_PRODUCTS).alias("products_returned"),
        seen.cast(MODEL_PRODUCTS).alias("positives"),
        unseen.cast(MODEL_PRODUCTS).alias("negatives"),
    )


def retrieval_counters(owners: DataFrame, triggers: DataFrame, rows: DataFrame) -> DataFrame:
    """Per split: triggers in the production table, outside the graph, in it, without category, unscored."""
    keys = ["split", "exec_code"]
    inside = triggers.select(*keys, F.lit(1).alias("inside"), F.col("category").isNull().alias("uncategorized"))
    scored = rows.select(*keys).distinct().withColumn("scored", F.lit(1))
    flags = owners.select(*keys).join(inside, keys, "left").join(scored, keys, "left")
    in_graph = F.col("inside").isNotNull()
    return flags.groupBy("split").agg(
        F.count("*").alias("prod"),
        F.count_if(~in_graph).alias("outside_graph"),
        F.count_if(in_graph).alias("in_graph"),
        F.count_if(in_graph & F.col("uncategorized")).alias("missing_category"),
        F.count_if(in_graph & F.col("scored").isNull()).alias("unscored"),
    )


def compare_lists(prod: DataFrame, model: DataFrame) -> DataFrame:
    """Per execution code: size of each pairwise overlap of the model, display and relevance lists."""
    both = prod.select("split", "exec_code", "products_returned_display", "products_returned_relevance").join(
        model.select("split", "exec_code", F.col("products_returned").alias("products_returned_model")),
        ["split", "exec_code"],
    )

    def overlap(a: str, b: str) -> Column:
        return F.size(
            F.array_intersect(item_ids(f"products_returned_{a}"), item_ids(f"products_returned_{b}"))
        ).alias(f"overlap_{a}_{b}")

    return both.select(
        "split",
        "exec_code",
        overlap("display", "relevance"),
        overlap("model", "display"),
        overlap("model", "relevance"),
    )


def named_products(results: DataFrame, column: str, catalog: DataFrame) -> DataFrame:
    """(split, exec_code, rank, item_id, name, image_url) of one list column."""
    flat = results.select("split", "exec_code", F.inline(column)).select("split", "exec_code", "rank", "item_id")
    names = catalog.groupBy("item_id").agg(F.min(F.struct("name", "image_url")).alias("meta"))
    return flat.join(names, "item_id", "left").select(
        "split", "exec_code", "rank", "item_id", "meta.name", "meta.image_url"
    )


def pair_features(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Add the element-wise product of both ends' vectors (src, dst node indices) as an ML vector."""
    first = features.select(F.col("node_idx").alias("src"), F.col("vector").alias("src_vector"))
    second = features.select(F.col("node_idx").alias("dst"), F.col("vector").alias("dst_vector"))
    product = array_to_vector(hadamard(F.col("src_vector"), F.col("dst_vector")))
    return pairs.join(first, "src").join(second, "dst").select(
        *pairs.columns, F.col("is_positive").cast("double").alias("label"), product.alias("features")
    )


def fit_pair_classifier(examples: DataFrame, iterations: int = 50, l2: float = 0.0) -> LogisticRegressionModel:
    """Logistic regression on the pair features."""
    return LogisticRegression(maxIter=iterations, regParam=l2).fit(examples)


def linear_scores(model: LogisticRegressionModel, examples: DataFrame) -> DataFrame:
    """(split, exec_code, src, dst, label, score): the fitted log-odds of each pair."""
    return model.transform(examples).select(
        "split", "exec_code", "src", "dst", "label", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("score")
    )


def pair_similarity(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(split, exec_code, src, dst, label, similarity): the dot product of both ends' vectors."""
    first = features.select(F.col("node_idx").alias("src"), F.col("vector").alias("src_vector"))
    second = features.select(F.col("node_idx").alias("dst"), F.col("vector").alias("dst_vector"))
    return pairs.join(first, "src").join(second, "dst").select(
        *pairs.columns,
        F.col("is_positive").cast("double").alias("label"),
        dot(F.col("src_vector"), F.col("dst_vector")).alias("similarity"),
    )


def log_odds(weights: Sequence[float], features: Sequence[str]) -> Column:
    """The bias `weights[0]` plus the weighted features."""
    terms = [F.lit(float(w)) * F.col(name) for w, name in zip(weights[1:], features, strict=True)]
    return reduce(Column.__add__, terms, F.lit(float(weights[0])))


def fit_by_newton(
    examples: DataFrame, features: Sequence[str], label: str = "label", l2: float = 0.0, steps: int = 8
) -> list[float]:
    """[bias, weights of `features`] of a logistic regression: the mean log loss plus l2 / 2 times the squared weights.

    Every step is one aggregate over the examples: mean gradient and mean second derivatives, which combine on the
    map side; the driver solves one system with a row per feature. All steps are taken, so the result can be followed
    with plain SQL. Rows with a null label or feature take no part; without any rows all weights are zero. The bias
    is not penalised. A system without a single solution (constant features without `l2`) is solved by least squares.
    """
    usable = reduce(Column.__and__, [F.col(c).isNotNull() for c in [label, *features]])
    rows = materialize(examples.where(usable).select(label, *features), "fit_examples")
    inputs = [F.lit(1.0), *[F.col(name).cast("double") for name in features]]
    cells = [(i, j) for i in range(len(inputs)) for j in range(i + 1)]
    penalty = np.diag([0.0, *[l2] * len(features)])
    weights = np.zeros(len(inputs))
    for _ in range(steps):
        odds = log_odds(weights.tolist(), features)
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
        judged = rows.select("*", chance.alias("_chance"))
        spread = F.col("_chance") * (F.lit(1.0) - F.col("_chance"))
        sums = judged.agg(
            *[F.avg((F.col("_chance") - F.col(label)) * x).alias(f"g{i}") for i, x in enumerate(inputs)],
            *[F.avg(spread * inputs[i] * inputs[j]).alias(f"h{i}_{j}") for i, j in cells],
        ).first()
        if sums["g0"] is None:
            break
        slope = np.array([sums[f"g{i}"] for i in range(len(inputs))]) + penalty @ weights
        curve = penalty.copy()
        for i, j in cells:
            curve[i, j] += sums[f"h{i}_{j}"]
            if i != j:
                curve[j, i] += sums[f"h{i}_{j}"]
        weights = weights - np.linalg.lstsq(curve, slope, rcond=None)[0]
    return weights.tolist()
