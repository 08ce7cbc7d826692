"""Exact nearest neighbours by inner product with the threshold algorithm over sorted lists."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of one task: candidates of a part, queries of a block.
PART_ROWS = 8_192
BLOCK_QUERIES = 512
FIRST_DEPTH = 16


class SortedLists:
    """Vectors with one list of their rows per dimension, in ascending order of the component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.rows = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.rows, axis=0)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, rows seen) of the k best rows but the query's own; equal scores go to smaller ids.

        Each list is read from the end that adds most to the score. Rows met in any list are scored in full.
        No unseen row can beat the bound, the score of a row with the last values read in all lists; reading
        stops once the bound is below the k-th best score (not equal: an unseen row might have a smaller id).
        """
        n = len(self.ids)
        seen = np.zeros(n, dtype=bool)
        seen[np.searchsorted(self.ids, query_id, "left") : np.searchsorted(self.ids, query_id, "right")] = True
        own = int(seen.sum())
        used = np.flatnonzero(query)
        falling = query[used] > 0
        best_rows = np.empty(0, dtype=np.int64)
        best_scores = np.empty(0)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            stop = min(n, depth + step)
            # All lists are the same if the query is zero.
            high, low = used[falling], used[~falling]
            met = [self.rows[n - stop : n - depth, high].ravel(), self.rows[depth:stop, low].ravel()]
            if not len(used):
                met = [np.arange(depth, stop)]
            fresh = np.zeros(n, dtype=bool)
            for rows in met:
                fresh[rows] = True
            fresh &= ~seen
            rows = np.flatnonzero(fresh)
            seen[rows] = True
            rows = np.concatenate((best_rows, rows))
            scores = np.concatenate((best_scores, self.vectors[rows[len(best_rows) :]] @ query))
            order = np.lexsort((self.ids[rows], -scores))[:k]
            best_rows, best_scores = rows[order], scores[order]
            depth, step = stop, step * 2
            last = np.where(falling, self.values[n - depth, used], self.values[depth - 1, used])
            if len(best_rows) == k and float(last @ query[used]) < best_scores[-1]:
                break
        return self.ids[best_rows], best_scores, int(seen.sum()) - own


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1).astype(np.float64)


def searcher(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and candidates.num_rows:
            lists = SortedLists(candidates["vec_id"].to_numpy(), _matrix(candidates))
            for query_id, query in zip(queries["vec_id"].to_pylist(), _matrix(queries), strict=True):
                ids, scores, _ = lists.search(query_id, query, k)
                found[0].extend([query_id] * len(ids))
                found[1].extend(ids.tolist())
                found[2].extend(scores.astype(np.int64).tolist())
        names = ("query_id", "vec_id", "score")
        return pa.table({name: pa.array(v, type=pa.int64()) for name, v in zip(names, found, strict=True)})

    return search


def quantized(vector: Column) -> Column:
    """floor(256 * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    id_column: str = "vec_id",
    vector_column: str = "vector",
    part_rows: int = PART_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query, all if fewer.

    Components x count as floor(256 * x). Ties go to the smaller id; rows with the query's own id are left out. Vectors
    that are null, empty or hold null or non-finite components take no part, nor do null ids; vectors meet those of
    their own length only. A repeated query is searched once; repeated candidates are rows of their own. Extra columns
    are not read.

    Candidates are hashed into parts of about `part_rows` rows, queries into blocks of about `block_queries`. A task
    gets one part and one block, builds the part's sorted lists and runs the threshold algorithm; a query's k best of
    each part meet in one window. Inner products stay exact below 2**53.
    """
    def prepared(df: DataFrame) -> DataFrame:
        vector = F.col(vector_column)
        rows = df.where(F.col(id_column).isNotNull() & usable(vector))
        rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), quantized(vector).alias("vector"))
        return rows.withColumn("dim", F.size("vector"))

    pool, asked = prepared(candidates), prepared(queries).dropDuplicates(["vec_id"])
    parts = max(1, math.ceil(pool.count() / part_rows))
    blocks = max(1, math.ceil(asked.count() / block_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pool = pool.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    keys = ["dim", "part", "block"]
    found = asked.groupBy(*keys).cogroup(pool.groupBy(*keys)).applyInArrow(
        searcher(k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
