"""Dense positions and running sums without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessiongraph.functions import scans
from sessiongraph.session import materialize, partitions_for, shuffle_partitions

# The scan travels with the plan, so the executors need no copy of this package.
cloudpickle.register_pickle_by_value(scans)

# Levels above the rows; 3 levels of 20 bits leave at most 16 values on top of a 64-bit id.
LEVELS = 3


def _before(column: str, within: Sequence[str], order: str) -> Column:
    window = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def dense_index(
    ids: DataFrame, id_column: str, index_column: str, within: Sequence[str] = (), bits: int = 20
) -> DataFrame:
    """Distinct integer ids numbered from 0 in ascending order, separately for each `within` value.

    A prefix sum over the bits of the id. Ids that agree in all but their low `bits` bits are numbered
    in one window; since ids are distinct it holds at most 2**bits rows. Their group counts are summed
    up the same way, level by level. No task gets more than 2**bits rows whatever the ids are, and the
    numbering depends on the ids alone, so nothing has to be materialized between two passes.
    """
    within = list(within)
    distinct = ids.select(*within, id_column).distinct()

    def high(level: int) -> Column:
        return F.shiftright(F.col(id_column), bits * level)

    rows = distinct.withColumn("_g1", high(1))
    in_group = Window.partitionBy(*within, "_g1").orderBy(id_column)
    rows = rows.withColumn("_pos", F.row_number().over(in_group) - 1)

    counts = distinct.groupBy(*within, *[high(n).alias(f"_g{n}") for n in range(1, LEVELS + 1)]).agg(
        F.count("*").alias("_n1")
    )
    tables = []
    for level in range(1, LEVELS + 1):
        groups = [f"_g{n}" for n in range(level, LEVELS + 1)]
        if level > 1:
            counts = counts.groupBy(*within, *groups).agg(F.sum(f"_n{level - 1}").alias(f"_n{level}"))
        tables.append(
            counts.select(
                *within, *groups, _before(f"_n{level}", [*within, *groups[1:]], groups[0]).alias(f"_o{level}")
            )
        )
    offsets = tables[-1]
    for level in range(LEVELS - 1, 0, -1):
        shared = [*within, *[f"_g{n}" for n in range(level + 1, LEVELS + 1)]]
        offsets = tables[level - 1].join(offsets, shared)
    total = reduce(Column.__add__, [F.col(f"_o{n}") for n in range(1, LEVELS + 1)])
    offsets = offsets.select(*within, "_g1", total.alias("_offset"))
    return rows.join(offsets, [*within, "_g1"]).select(
        *within, id_column, (F.col("_pos") + F.col("_offset")).cast("long").alias(index_column)
    )


def running_sums(
    df: DataFrame, order: Sequence[Column], sums: Sequence[str], within: Sequence[str] = (), rows: int = 0
) -> DataFrame:
    """Add `before_<c>` for each whole-number column c of `sums`: its sum over all rows that sort earlier, in the same
    `within` group if there are any.

    Rows must be unique under `order` in their group; `order` may mix types and directions. Rows are sorted by group
    and order over ranges, so groups of any size are spread over partitions, and are summed up in the stage that sorts
    them. What a partition's first group has in partitions before it is added when the stored rows are read: one row
    per partition. `rows`, where it is known, is a bound on the number of rows; partitions grow with it.
    """
    within = list(within)
    n = max(shuffle_partitions(df.sparkSession), partitions_for(df.sparkSession, rows) if rows else 0)
    full_order = [*[F.col(c) for c in within], *order]
    added = ["_part int", "_pos long", *[f"_r_{c} long" for c in sums]]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *added])
    scan = scans.running_sums(within, list(sums), df.columns)
    stored = materialize(
        df.repartitionByRange(n, *full_order).sortWithinPartitions(*full_order).mapInArrow(scan, schema), "summed"
    )
    key = F.struct(F.lit(0).alias("_all"), *within)
    # The ends of the partitions are looked up first: taking keys by place over all rows would sort them once more.
    ends = stored.groupBy("_part").agg(F.min("_pos").alias("_first"), F.max("_pos").alias("_last"))
    outer = stored.join(F.broadcast(ends), "_part").where(F.col("_pos").isin(F.col("_first"), F.col("_last")))
    tails = outer.groupBy("_part").agg(
        F.min_by(key, "_pos").alias("low"),
        F.max_by(key, "_pos").alias("high"),
        *[F.max_by(F.col(f"_r_{c}") + F.col(c), "_pos").alias(f"_t_{c}") for c in sums],
    )
    # A group that goes on covers whole partitions in a row, so its sums up to a partition are those of its tails.
    of_group = Window.partitionBy("high").orderBy("_part")
    upto = of_group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = tails.select("*", *[F.sum(f"_t_{c}").over(upto).alias(f"_u_{c}") for c in sums])
    in_order = Window.orderBy("_part")
    goes_on = F.lag("high").over(in_order) == F.col("low")
    carried = tails.select(
        F.col("_part").alias("_of"),
        F.col("low").alias("_low"),
        *[F.when(goes_on, F.lag(f"_u_{c}").over(in_order)).alias(f"_c_{c}") for c in sums],
    )
    carried = F.broadcast(carried.where(" or ".join(f"`_c_{c}` is not null" for c in sums)))
    same = (F.col("_part") == F.col("_of")) & key.eqNullSafe(F.col("_low"))
    return stored.join(carried, same, "left").select(
        *df.columns, *[(F.col(f"_r_{c}") + F.coalesce(f"_c_{c}", F.lit(0))).alias(f"before_{c}") for c in sums]
    )


def ordered_rows(df: DataFrame, order: Sequence[Column], index_column: str) -> DataFrame:
    """Number all rows from 0 in the given order; rows alike in every column are interchangeable.

    One shuffle, into sorted ranges; rows are numbered in the stage that sorts them, and the number of rows in earlier
    ranges, one per partition, is added when they are read. Equal rows differ in a last sort key of their own, so
    copies never pile up in one range.
    """
    n = shuffle_partitions(df.sparkSession)
    full_order = [*order, F.col("_tie")]
    ordered = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *full_order)
        .sortWithinPartitions(*full_order)
        .drop("_tie")
        # The partition's number above 33 bits of the row's place in it.
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = materialize(ordered, "numbered")
    part = F.shiftright("_place", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", _before("_n", [], "_part").alias("_before"))
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(F.broadcast(offsets), part == F.col("_part")).select(
        *df.columns, (place + F.col("_before")).cast("long").alias(index_column)
    )


def batch_ids(df: DataFrame, order: Sequence[Column], batch_size: int) -> DataFrame:
    """Rows with `row_idx` and `batch_id`; every batch but the last holds `batch_size` rows."""
    return ordered_rows(df, order, "row_idx").withColumn(
        "batch_id", F.floor(F.col("row_idx") / F.lit(batch_size))
    )


def batch_count(df: DataFrame, batch_size: int) -> DataFrame:
    """One row: the number of batches, at least one."""
    full = F.ceil(F.count("*") / F.lit(batch_size))
    return df.agg(F.greatest(full, F.lit(1)).cast("long").alias("n_batches"))
