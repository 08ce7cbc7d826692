"""Connected components of an undirected graph given as pairs of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.session import materialize


def components(pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id of the component of every id in `pairs` (a, b); self-pairs are ignored.

    Alternating large and small stars: each round every node hands its larger (then its smaller) neighbours
    to its smallest one, until all edges point at roots. Rounds grow with the logarithm of the size. Edges
    stay distinct pairs, so a hot node costs one row per neighbour, and the minimum per node combines on the
    map side. Rounds are stored tables in the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(
        pairs.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        edges = materialize(small.where(a != b).union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())
