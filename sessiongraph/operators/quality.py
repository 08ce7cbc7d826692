"""Data checks. Each returns a small report; `require` turns a broken report into an error."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Matrix cells that cannot occur in a session type.
FORCED_ZERO = {
    "positive": ("model_only", "neither"),
    "full_negative": ("both_find", "prod_only"),
}


def require(report: DataFrame, holds: Column, message: str) -> None:
    """Raise ValueError with the first offending row unless `holds` is true on every row of `report`."""
    broken = report.where(~F.coalesce(holds, F.lit(False))).head(1)
    if broken:
        raise ValueError(f"{message}: {broken[0].asDict()}")


def lost_endpoints(remapped: DataFrame) -> DataFrame:
    """One row: edges, and edges with an end that has no node index."""
    return remapped.agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("lost"),
    )


def index_range(pairs: DataFrame, n_nodes: Column) -> DataFrame:
    """One row: pairs, smallest and largest node index, pairs with an index outside [0, n_nodes)."""

    def outside(c: str) -> Column:
        return (F.col(c) < 0) | (F.col(c) >= n_nodes)

    return pairs.agg(
        F.count("*").alias("pairs"),
        F.min(F.least("src", "dst")).alias("lowest"),
        F.max(F.greatest("src", "dst")).alias("highest"),
        F.count_if(outside("src") | outside("dst")).alias("out_of_range"),
    )


def zero_vectors(features: DataFrame) -> DataFrame:
    """One row: nodes, nodes whose vector is all zero, and their share."""
    zero = F.forall("vector", lambda x: x == 0)
    return features.agg(
        F.count("*").alias("nodes"),
        F.count_if(zero).alias("missing"),
        F.avg(zero.cast("int")).alias("missing_ratio"),
    )


def counts_match(actual: DataFrame, expected: DataFrame, label: str) -> DataFrame:
    """One row: row counts of two tables that should agree."""
    wanted = expected.agg(F.count("*")).scalar()
    return actual.agg(F.count("*").alias("actual")).select(
        F.lit(label).alias("label"),
        "actual",
        wanted.alias("expected"),
        (wanted - F.col("actual")).alias("lost"),
    )


def node_count(nodes: DataFrame, expected: int | None) -> DataFrame:
    """One row: number of nodes and whether it is the expected one; no expectation always agrees."""
    agrees = F.lit(True) if expected is None else F.col("n_nodes") == expected
    return nodes.agg(F.count("*").alias("n_nodes")).withColumn("as_expected", agrees)


def alignment(prod: DataFrame, model: DataFrame) -> DataFrame:
    """One row: execution codes on both sides, and those that name different trigger items."""
    keys = ["split", "exec_code"]
    both = prod.select(*keys, F.col("trigger_id").alias("prod_trigger")).join(
        model.select(*keys, F.col("trigger_id").alias("model_trigger")), keys
    )
    return both.agg(
        F.count("*").alias("compared"),
        F.count_if(F.col("prod_trigger") != F.col("model_trigger")).alias("mismatched"),
    )


def impossible_cells(matrices: DataFrame) -> DataFrame:
    """(arm, session_type, cells): sum over the cells of each matrix that must be zero."""
    impossible = reduce(
        Column.__or__,
        [(F.col("session_type") == t) & F.col("case").isin(*cases) for t, cases in FORCED_ZERO.items()],
    )
    return matrices.where(impossible).groupBy("arm", "session_type").agg(F.sum("count").alias("cells"))


def loss_ledger(steps: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(step, rows_in, rows_out) for each (name, before, after)."""
    sides = [
        side.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("step"), F.lit(i == 0).alias("before"), "n"
        )
        for name, *tables in steps
        for i, side in enumerate(tables)
    ]
    stacked = reduce(DataFrame.unionByName, sides)
    return stacked.groupBy("step").agg(
        F.max(F.when(F.col("before"), F.col("n"))).alias("rows_in"),
        F.max(F.when(~F.col("before"), F.col("n"))).alias("rows_out"),
    )


def passing(df: DataFrame, steps: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(step, rows_in, rows_out) of several exclusions on one table, counted in one pass over it.

    Each step is (name, reaches it, passes it). Counts are plain aggregates, so repeated tasks do not count twice.
    """

    def number(holds: Column) -> Column:
        return F.count_if(F.coalesce(holds, F.lit(False)))

    cells = [
        F.struct(F.lit(name).alias("step"), number(before).alias("rows_in"), number(before & after).alias("rows_out"))
        for name, before, after in steps
    ]
    return df.agg(F.array(*cells).alias("steps")).select(F.inline("steps"))


def conflicting_values(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """One row: keys, and keys that come with more than one value.

    Compares the smallest with the largest value, which combines on the map side, instead of counting
    distinct values.
    """
    spread = df.groupBy(*key).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return spread.agg(
        F.count("*").alias("keys"), F.count_if(F.col("low") != F.col("high")).alias("conflicts")
    )


def schema_drift(df: DataFrame, expected: T.StructType) -> list[tuple[str, str | None, str | None]]:
    """(column, expected type, found type) for each column that differs; nullability is ignored."""
    wanted = {f.name: f.dataType.simpleString() for f in expected}
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*wanted, *[n for n in found if n not in wanted]]
    return [(n, wanted.get(n), found.get(n)) for n in names if wanted.get(n) != found.get(n)]
