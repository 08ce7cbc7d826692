"""Seeded draws that any engine with MD5 can repeat, for sampling that must not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(keys: list[Column], seed: int) -> Column:
    """A number of 60 bits from the keys and the seed: the first 15 hex digits of an MD5."""
    text = F.concat_ws("|", *[key.cast("string") for key in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draw_sql(*keys: str, seed: int) -> str:
    """The SQL form of `draw`."""
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, {seed})), 1, 15) as bigint)"
