"""Block scoring on Arrow tables, run inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

# Scores keep this many bits of their own size, so that equal vectors tie in any block shape and small scores keep
# their order.
SCORE_BITS = 40
# Scores that are rounded and merged at once; that takes some ten arrays of them.
MERGED_SCORES = 1 << 18


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as a two-dimensional array."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def kept_bits(scores: np.ndarray) -> np.ndarray:
    """Scores rounded to `SCORE_BITS` binary digits, relative to each one's size."""
    digits, exponent = np.frexp(scores)
    return np.ldexp(np.rint(np.ldexp(digits, SCORE_BITS)), exponent - SCORE_BITS)


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) positions of the k largest entries per row; equal entries go to the lower column.

    Entries of minus infinity are left out.
    """
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        keep = scores > kth
        tied = scores == kth
        room = k - keep.sum(axis=1, keepdims=True)
        keep |= tied & (np.cumsum(tied, axis=1) <= room)
    else:
        keep = np.ones(scores.shape, dtype=bool)
    return np.nonzero(keep & np.isfinite(scores))


def unit_rows(vectors: np.ndarray, smallest: float) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.maximum(lengths, smallest)[:, None]


class Tiles:
    """Rows of a block in tiles of rows that lie near each other, with the center and reach of each tile.

    Rows are sorted by the nearest of some evenly spaced rows of the block and cut into tiles of at most `size`. A tile
    that is half full ends with its last whole group, so that few tiles hold rows of groups far apart.
    """

    def __init__(self, vectors: np.ndarray, size: int) -> None:
        pivots = vectors[:: max(1, int(np.sqrt(len(vectors))))]
        sizes = (pivots * pivots).sum(axis=1) / 2
        nearest = np.concatenate(
            [np.argmax(vectors[i : i + size] @ pivots.T - sizes, axis=1) for i in range(0, len(vectors), size)]
        )
        order = np.argsort(nearest, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(nearest[order])) + 1, len(order))
        self.rows = []
        start = 0
        while start < len(order):
            stop = start + size
            last = int(ends[np.searchsorted(ends, min(stop, len(order)), "right") - 1])
            stop = last if last >= start + size // 2 else min(stop, len(order))
            self.rows.append(np.sort(order[start:stop]))
            start = stop
        self.centers = np.array([vectors[r].mean(axis=0) for r in self.rows])
        self.reach = np.array(
            [np.sqrt(((vectors[r] - c) ** 2).sum(axis=1).max()) for r, c in zip(self.rows, self.centers, strict=True)]
        )


def merged_best(
    scores: np.ndarray, ids: np.ndarray, new_scores: np.ndarray, new_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two sets of candidates per row, best score first, then lower id."""
    scores, ids = np.concatenate([scores, new_scores], axis=1), np.concatenate([ids, new_ids], axis=1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def tile_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns per row in no order, filled up with minus infinity; `ids` ascend, lower ones win ties."""
    rows, columns = best_columns(scores, k)
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best = np.full((len(scores), k), -np.inf)
    named = np.full((len(scores), k), np.iinfo(np.int64).max)
    best[rows, place], named[rows, place] = scores[rows, columns], ids[columns]
    return best, named


def square_best(
    queries: np.ndarray,
    query_ids: np.ndarray,
    pool: np.ndarray,
    item_ids: np.ndarray,
    k: int,
    exclude_self: bool,
    query_tile: int,
    pool_tile: int,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, tiles looked into): the k best pool rows of each query, `item_ids` ascending.

    A tile's scores cannot exceed the score of its center plus the query's length times the tile's reach. Tiles are
    taken in order of that bound; those where no query of the tile of queries can gain are skipped. The bound has some
    room for rounding, so skipping never changes the answer.
    """
    tiles = Tiles(pool, pool_tile)
    looked = 0
    all_scores, all_ids = no_best(len(queries), k)
    longest = np.sqrt(np.einsum("ij,ij->i", pool, pool).max())
    for rows in Tiles(queries, query_tile).rows:
        asked = queries[rows]
        lengths = np.sqrt(np.einsum("ij,ij->i", asked, asked))
        room = 1e-9 * lengths * longest
        bounds = asked @ tiles.centers.T + lengths[:, None] * tiles.reach + room[:, None]
        best = all_scores[rows], all_ids[rows]
        own = query_ids[rows] if exclude_self else None
        for t in np.argsort(-bounds.max(axis=0), kind="stable"):
            if (bounds[:, t] < best[0][:, -1]).all():
                continue
            looked += 1
            members = tiles.rows[t]
            improve(best, np.arange(len(rows)), asked @ pool[members].T, own, item_ids[members], k, room)
        all_scores[rows], all_ids[rows] = best
    return all_scores, all_ids, looked


def no_best(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of n queries that have found nothing yet."""
    return np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)


def improve(
    best: tuple[np.ndarray, np.ndarray],
    rows: np.ndarray,
    found: np.ndarray,
    own: np.ndarray | None,
    ids: np.ndarray,
    k: int,
    room: np.ndarray,
) -> None:
    """Put the scores `found` of the queries `rows` against the items `ids`, ascending, into the `best` of all queries.

    `own` are the queries' ids, which are no answers of theirs. Only rows that hold a score above the k-th less `room`,
    which covers its rounding, are rounded and merged, `MERGED_SCORES` at once, so that `found` is the one large array.
    """
    if own is not None:
        found[own[rows][:, None] == ids[None, :]] = -np.inf
    scores, named = best
    gaining = np.flatnonzero(found.max(axis=1) >= scores[rows, -1] - room[rows])
    step = max(1, MERGED_SCORES // found.shape[1])
    for start in range(0, len(gaining), step):
        some = gaining[start : start + step]
        at = rows[some]
        scores[at], named[at] = merged_best(scores[at], named[at], *tile_best(kept_bits(found[some]), ids, k), k)


def block_scorer(
    group: str, k: int, exclude_self: bool, smallest: float | None, query_tile: int, pool_tile: int
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A cogroup function: the k best pool items of one pool block for each query of one query block.

    With `smallest` given, vectors are scaled to length one here, so they travel as they are stored.
    """

    def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
        return matrix(column) if smallest is None else unit_rows(matrix(column), smallest)

    def score(queries: pa.Table, pool: pa.Table) -> pa.Table:
        query_ids = item_ids = np.empty(0, dtype=np.int64)
        scores = np.empty(0)
        label = None
        if queries.num_rows and pool.num_rows:
            label = queries[group][0].as_py()
            pool = pool.sort_by("item_id")
            asked = queries["query_id"].to_numpy()
            best, ids, _ = square_best(
                vectors_of(queries["vector"]),
                asked,
                vectors_of(pool["item_vector"]),
                pool["item_id"].to_numpy(),
                k,
                exclude_self,
                query_tile,
                pool_tile,
            )
            rows, columns = np.nonzero(np.isfinite(best))
            query_ids, item_ids, scores = asked[rows], ids[rows, columns], best[rows, columns]
        return pa.table(
            {
                group: pa.array([label] * len(scores), type=queries.schema.field(group).type),
                "query_id": pa.array(query_ids, type=pa.int64()),
                "item_id": pa.array(item_ids, type=pa.int64()),
                "score": pa.array(scores, type=pa.float64()),
            }
        )

    return score
