"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# One hexadecimal digit stands for 4 bits; 12 digits fit a double exactly.
DIGITS = 12
ROWS_PER_BUCKET = 250_000


def unit(key: Column) -> Column:
    """A hash of the text `key`, evenly spread over the open interval (0, 1)."""
    number = F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return (number + 0.5) / float(16**DIGITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score -weight / ln(hash(key, shard)); shards of weight 0 get nothing.

    A shard's score depends on the key and that shard alone. One more shard therefore takes rows only into
    itself, a removed one gives rows only to the others, and shares follow the weights.
    """
    scored = [
        F.struct(
            (F.lit(-float(weight)) / F.log(unit(F.concat_ws(":", key, F.lit(str(shard)))))).alias("score"),
            F.lit(-shard).alias("shard"),
        )
        for shard, weight in enumerate(weights)
        if weight > 0
    ]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["shard"]).cast("int")


def shard_rows(
    df: DataFrame,
    weights: Sequence[float],
    id_column: str = "doc_id",
    text_column: str = "text",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """All rows with their shard, the shard after one more of mean weight, and a gapless slot in the shard.

    Null text: size 1, checksum 0. A null id is a key of its own ("null"). Repeated ids land in one shard
    and get slots of their own. An empty table gives no rows. Extra columns are not read.

    Slots run by (bucket, id, checksum): a bucket is a hash class of ids with about `rows_per_bucket` rows of
    the whole table, so a window holds only a shard's part of it; bucket counts, summed up per shard, give the
    offsets.
    """
    key = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    mean = sum(weights) / len(weights)
    rows = df.select(
        F.col(id_column).alias("doc_id"),
        (F.coalesce(F.octet_length(text_column), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_column).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, mean]).alias("grown_shard"),
        unit(key).alias("_unit"),
    )
    buckets = max(1, -(-df.select(id_column).count() // rows_per_bucket))
    rows = rows.withColumn("_bucket", F.floor(F.col("_unit") * buckets).cast("long")).drop("_unit")
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("_place", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "_bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        "shard",
        (F.col("_place") + F.col("_offset")).cast("long").alias("slot"),
        "grown_shard",
    )
