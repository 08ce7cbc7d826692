"""Preparing labelled pairs: capping, drawing and batching negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongraph.functions.draws import draw
from sessiongraph.operators.coview import canonical_pair
from sessiongraph.operators.index import ordered_rows, running_sums
from sessiongraph.session import partitions_for

# Fixed value: negatives kept per positive.
DEFAULT_RATIO = 5


def cap_negatives(
    positives: DataFrame, negatives: DataFrame, group: list[str], order: list[str], ratio: int = DEFAULT_RATIO
) -> DataFrame:
    """The first `ratio` x positives negatives of each group, in `order`; no positives, no negatives.

    `order` must tell the negatives of a group apart. Positions come from a global range sort, so a
    group of any size is spread over many tasks.
    """
    quota = positives.groupBy(*group).agg((F.count("*") * ratio).alias("_quota"))
    wanted = negatives.join(quota, group).withColumn("_one", F.lit(1))
    placed = running_sums(wanted, [F.col(c) for c in order], ["_one"], group)
    return placed.where(F.col("before__one") < F.col("_quota")).select(*negatives.columns)


def epoch_sample(
    positives: DataFrame, negatives: DataFrame, ratio: int = DEFAULT_RATIO, seed: int = 42
) -> DataFrame:
    """All positives and `ratio` x as many negatives drawn without replacement, in shuffled order.

    Negatives are ordered by a seeded hash and the first ones taken, all of them where there are fewer.
    `position` gives the shuffled order. Another seed gives another epoch.
    """
    columns = negatives.columns
    quota = positives.agg((F.count("*") * ratio).alias("n")).scalar()
    counted = negatives.groupBy(*columns).agg(F.count("*").alias("_copies"))
    drawn = counted.withColumn("_draw", draw([F.col(c) for c in columns], seed))
    placed = running_sums(drawn, [F.col("_draw"), *[F.col(c) for c in columns]], ["_copies"])
    left = F.least(F.col("_copies"), quota - F.col("before__copies"))
    taken = placed.where(left > 0).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), left)).alias("_c"))
    labelled = positives.select(*columns, F.lit(1.0).alias("label")).unionByName(
        taken.select(*columns, F.lit(0.0).alias("label"))
    )
    shuffled = [draw([F.col(c) for c in [*columns, "label"]], seed + 1), *[F.col(c) for c in [*columns, "label"]]]
    return ordered_rows(labelled, shuffled, "position")


def _owned(rows: DataFrame) -> tuple[list[Column], list[str]]:
    """The columns of `rows` renamed to `for_<name>`, as columns and as names."""
    return [F.col(c).alias(f"for_{c}") for c in rows.columns], [f"for_{c}" for c in rows.columns]


def _pair_number(lo: Column, hi: Column, n_nodes: int) -> Column:
    """The place of a pair lo < hi among all pairs of `n_nodes` nodes in ascending order."""
    return lo * F.lit(n_nodes - 1) - F.shiftright(lo * (lo - 1), 1) + hi - lo - 1


def _first_of(lo: Column, n_nodes: int) -> Column:
    return _pair_number(lo, lo + 1, n_nodes)


def _low_node(place: Column, n_nodes: int) -> Column:
    """The lower node of the pair at a place: the largest one whose first pair is not behind it.

    The root of the triangle from the end is off by one at most, which the comparison puts right.
    """
    from_end = (F.lit(n_nodes * (n_nodes - 1) // 2) - place).cast("double")
    about = F.floor((F.lit(2 * n_nodes - 1) - F.sqrt(from_end * 8 + 1)) / 2).cast("long")
    about = F.greatest(F.lit(0).cast("long"), F.least(F.lit(max(n_nodes - 2, 0)).cast("long"), about))
    return F.when(_first_of(about + 1, n_nodes) <= place, about + 1).when(
        _first_of(about, n_nodes) > place, about - 1
    ).otherwise(about)


def random_non_edges(positives: DataFrame, nodes: DataFrame, known: DataFrame, seed: int = 42) -> DataFrame:
    """One random pair (src, dst) per positive row that is neither a known edge nor a self-pair.

    `positives` are rows of integer columns, `nodes` holds the indices 0..N-1. All pairs have a place in ascending
    order. A positive draws a number t below the number of free pairs by a seeded hash; its pair is the t-th free one,
    which is found by rank, whatever share of the pairs is free: with a_i the place of the i-th known pair, a_i - i free
    pairs lie before it, so the t-th free pair has the place t plus the number of known pairs with a_i - i <= t. Both
    counts are running sums over range sorts. A second draw decides on the direction. Drawn pairs may repeat; a graph
    that has all pairs gives no rows. Known pairs outside the nodes do not count.
    """
    n = nodes.count()
    n_known, n_asked = known.count(), positives.count()
    parts = partitions_for(positives.sparkSession, n_known)
    inside = (F.col("lo") >= 0) & (F.col("lo") < F.col("hi")) & (F.col("hi") < n)
    pairs = canonical_pair(known.select("src", "dst")).where(inside).select("lo", "hi")
    taken = pairs.repartition(parts, "lo", "hi").distinct()
    places = taken.select(_pair_number(F.col("lo"), F.col("hi"), n).alias("place"), F.lit(1).alias("one"))
    numbered = running_sums(places, [F.col("place")], ["one"], rows=n_known)
    free_before = numbered.select((F.col("place") - F.col("before_one")).alias("at"))
    all_pairs = n * (n - 1) // 2
    free = all_pairs - free_before.count()
    renamed, own = _owned(positives)
    drawn = positives.select(*renamed)
    if free <= 0:
        return drawn.limit(0).withColumns({"src": F.lit(0).cast("long"), "dst": F.lit(0).cast("long")})
    keys = [F.col(c) for c in own]
    asked = drawn.withColumn("at", F.pmod(draw(keys, seed), F.lit(free)).cast("long"))
    asked = asked.withColumn("known", F.lit(0))
    # Equal known rows are counted, so that all rows of the sort differ; positives are numbered by their columns.
    edges = free_before.repartition(parts, "at").groupBy("at").agg(F.count("*").cast("int").alias("known"))
    edges = edges.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in drawn.schema], "at", "known")
    order = [F.col("at"), (F.col("known") == 0).alias("is_asked"), *keys]
    ranked = running_sums(edges.unionByName(asked), order, ["known"], rows=n_known + n_asked)
    ranked = ranked.where(F.col("known") == 0)
    ranked = ranked.withColumn("place", F.col("at") + F.col("before_known"))
    found = ranked.withColumn("lo", _low_node(F.col("place"), n))
    found = found.withColumn("hi", F.col("place") - _first_of(F.col("lo"), n) + F.col("lo") + 1)
    ahead = F.pmod(draw(keys, seed + 1), F.lit(2)) == 0
    return found.select(
        *own,
        F.when(ahead, F.col("lo")).otherwise(F.col("hi")).alias("src"),
        F.when(ahead, F.col("hi")).otherwise(F.col("lo")).alias("dst"),
    )


def draw_stored_negatives(
    positives: DataFrame, negatives: DataFrame, ratio: int = DEFAULT_RATIO, seed: int = 42
) -> DataFrame:
    """`ratio` stored negatives per positive, drawn with replacement.

    Negatives are numbered 0..N-1; a draw is a seeded hash modulo N, joined on the number.
    """
    numbered = ordered_rows(negatives.select("src", "dst"), [F.col("src"), F.col("dst")], "number")
    n_negatives = negatives.agg(F.count("*")).scalar()
    renamed, own = _owned(positives)
    draws = positives.select(*renamed, F.explode(F.sequence(F.lit(1), F.lit(ratio))).alias("draw"))
    keys = [F.col(c) for c in [*own, "draw"]]
    return draws.withColumn("number", F.pmod(draw(keys, seed), F.greatest(n_negatives, F.lit(1)))).join(
        numbered, "number"
    ).select(*own, "draw", "src", "dst")


def aligned_negatives(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """The i-th stored negative for the i-th positive, both in ascending (src, dst) order."""
    order = [F.col("src"), F.col("dst")]
    first = ordered_rows(
        positives.select("src", "dst"), order, "number"
    ).withColumnsRenamed({"src": "for_src", "dst": "for_dst"})
    return first.join(ordered_rows(negatives.select("src", "dst"), order, "number"), "number")


def labelled_union(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives with label 1.0 and negatives with label 0.0 in one table."""
    return positives.withColumn("label", F.lit(1.0)).unionByName(negatives.withColumn("label", F.lit(0.0)))

