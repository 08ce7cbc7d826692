"""Near-duplicate vectors by an index of permutations of reference points."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongraph.llm.components import components
from sessiongraph.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIMILARITY = 0.95
# How many reference points two vectors must share to be compared. How many a vector is described by is the least
# number within NEAREST for which a pair at the threshold shares so many in RECALL of the cases, by drawn partners of
# CALIBRATED sampled vectors.
SHARED = 3
NEAREST, RECALL, CALIBRATED = range(6, 13), 0.99, 512
# The reference points are a sample: PIVOTS_PER_ROOT times the root of the number of vectors (the root whose order is
# the number of points that name a list), within PIVOT_BYTES. Lists then have a tenth of a member on average.
PIVOTS_PER_ROOT, LEAST_PIVOTS, PIVOT_BYTES = 15.0, 64, 16_000_000
# Postings of one list block, and postings of one task.
LIST_ROWS, TASK_ROWS = 2_048, 16_384
PAIRS = 200_000
# Bits of a reference point's number in the name of a list, by the number of points that name it.
POINT_BITS = {2: 31, 3: 21}


def usable(vector: Column) -> Column:
    """Not null or empty, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def units(column: pa.ListArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lengths): the vectors scaled to length one in double precision, as rows of a table.

    Shorter vectors end in zeros; with a `width`, longer ones are cut.
    """
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), int(lengths.max(initial=1))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)
    out /= np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    if width is not None:
        out = out[:, :width] if out.shape[1] > width else np.pad(out, ((0, 0), (0, width - out.shape[1])))
    return out, lengths


def describer(pivots: np.ndarray, nearest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass that adds the numbers of the nearest reference points, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2_048):
                batch = whole.slice(start, 2_048)
                angles = units(batch.column(1), pivots.shape[1])[0] @ pivots.T
                near = np.argpartition(-angles, nearest - 1, axis=1)[:, :nearest] if nearest < len(pivots) else None
                near = np.tile(np.arange(len(pivots)), (len(angles), 1)) if near is None else near
                order = np.argsort(-np.take_along_axis(angles, near, axis=1), axis=1, kind="stable")
                numbers = np.take_along_axis(near, order, axis=1).astype(np.int32)
                numbers = pa.array(list(numbers), type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), numbers], names=["node", "vector", "pivots"]
                )

    return run


def pair_numbers(first: np.ndarray, size: np.ndarray, chunk: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of rows of one run each, in chunks; run r covers `first[r]` to `first[r] + size[r]`."""
    rows = np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)
    after = np.repeat(first + size, size) - rows - 1
    edges = np.cumsum(after)
    start = 0
    while start < len(rows):
        before = edges[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(edges, before + chunk, "right")))
        n = after[start:stop]
        left = np.repeat(rows[start:stop], n)
        yield left, left + 1 + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = stop


def roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest number connected with each of `n` numbers by the given pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        grown = root.copy()
        np.minimum.at(grown, root[left], low)
        np.minimum.at(grown, root[right], low)
        while not np.array_equal(jumped := grown[grown], grown):
            grown = jumped
        if (grown == root).all():
            return root
        root = grown


def verifier(similarity: float, shared: int) -> Callable[[pa.Table], pa.Table]:
    """The group function: links among the postings of some lists, as counts and a spanning forest per node.

    A pair is compared in the list of its smallest common reference points only, though it meets in others.
    """

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        keys, node, block = (table[c].to_numpy() for c in ("key", "node", "block"))
        copies = table["copies"].to_numpy()
        matrix, lengths = units(table["vector"].combine_chunks())
        # All vectors are described by equally many reference points.
        pivots = table["pivots"].combine_chunks().flatten().to_numpy().astype(np.int64)
        pivots = np.sort(pivots.reshape(table.num_rows, -1), axis=1)
        _, first, size = np.unique(keys, return_index=True, return_counts=True)
        names, place = np.unique(node, return_inverse=True)
        links = np.zeros(len(names), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in pair_numbers(first, size):
            if low != high:
                across = block[i] != block[j]
                i, j = i[across], j[across]
            same = pivots[i][:, :, None] == pivots[j][:, None, :]
            common = same.any(axis=2)
            enough = common.sum(axis=1) >= shared
            enough &= (node[i] != node[j]) & (lengths[i] == lengths[j])
            i, j, common = i[enough], j[enough], common[enough]
            # The smallest common points of a pair name the list that decides on it.
            own = np.zeros(len(i), dtype=np.int64)
            for _ in range(shared):
                least = common.argmax(axis=1)
                common[np.arange(len(i)), least] = False
                own = (own << POINT_BITS[shared]) + pivots[i, least]
            own = own == keys[i]
            i, j = i[own], j[own]
            linked = np.einsum("ij,ij->i", matrix[i], matrix[j]) >= similarity
            i, j = i[linked], j[linked]
            if len(i):
                np.add.at(links, place[i], copies[j])
                np.add.at(links, place[j], copies[i])
                found.append((place[i], place[j]))
        forest = np.arange(len(names))
        if found:
            forest = roots(*(np.concatenate(side) for side in zip(*found, strict=True)), len(names))
        some = np.flatnonzero(links)
        return pa.table(
            {
                "node": pa.array(names[some], type=pa.int64()),
                "links": pa.array(links[some], type=pa.int64()),
                "other": pa.array(names[forest[some]], type=pa.int64()),
            }
        )

    return verify


def pivot_count(n: int, width: int, shared: int) -> int:
    """Reference points for `n` vectors of `width` components."""
    wanted = max(LEAST_PIVOTS, math.ceil(PIVOTS_PER_ROOT * n ** (1 / shared)))
    return max(1, min(wanted, PIVOT_BYTES // (8 * max(width, 1)), 1 << POINT_BITS[shared]))


def nearest_needed(points: np.ndarray, sample: np.ndarray, similarity: float, shared: int, recall: float) -> int:
    """The least number within `NEAREST` of nearest reference points with which a pair at the threshold is found in
    `recall` of the cases; the largest if none suffices."""
    draw = np.random.default_rng(1)
    aside = draw.normal(size=sample.shape)
    aside -= np.einsum("ij,ij->i", aside, sample)[:, None] * sample
    aside /= np.maximum(np.sqrt(np.einsum("ij,ij->i", aside, aside)), 1e-12)[:, None]
    partner = similarity * sample + math.sqrt(max(0.0, 1 - similarity**2)) * aside
    left, right = (np.argsort(-(side @ points.T), axis=1)[:, : NEAREST[-1]] for side in (sample, partner))
    common = left[:, :, None] == right[:, None, :]
    for n in NEAREST:
        if (common[:, :n, :n].sum(axis=(1, 2)) >= shared).mean() >= recall:
            return n
    return NEAREST[-1]


def set_apart(rows: np.ndarray, similarity: float, block: int = 256) -> np.ndarray:
    """The rows that are no closer to an earlier one kept than twice the angle of `similarity`.

    Without this, a large group of near copies would give many of the points, and which of these are nearest says
    nothing about its members.
    """
    limit = max(0.0, 2 * similarity**2 - 1) if similarity > 0 else 1.0
    kept = rows[:0]
    for start in range(0, len(rows), block):
        part = rows[start : start + block]
        if len(kept):
            part = part[(part @ kept.T).max(axis=1) < limit]
        close = np.triu(part @ part.T >= limit, 1)
        free = np.ones(len(part), dtype=bool)
        for place in range(len(part)):
            if free[place]:
                free &= ~close[place]
        kept = np.concatenate((kept, part[free]))
    return kept


def describe(sets: DataFrame, similarity: float = SIMILARITY, shared: int = SHARED, recall: float = RECALL) -> DataFrame:
    """(node, vector, pivots) of (node, vector) rows: the ordered numbers of the nearest reference points.

    The reference points are of the vectors first in hash order, set apart from each other; `pivot_count` bounds them.
    Where there are fewer than `LEAST_PIVOTS`, drawn directions make up for them. Vectors of other lengths than theirs are padded or cut for the
    description alone.
    """
    schema = sets.select("node", "vector", F.array(F.lit(0)).alias("pivots")).schema
    n, width = sets.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    n_points = pivot_count(n, width, shared)
    first = sets.orderBy(F.xxhash64("vector"), "node").limit(2 * n_points + CALIBRATED).select("vector").toArrow()
    if not first.num_rows:
        return sets.select("node", "vector", F.array(F.lit(0)).alias("pivots"))
    rows, _ = units(first["vector"].combine_chunks())
    points, sample = set_apart(rows[: 2 * n_points], similarity)[:n_points], rows[-CALIBRATED:]
    drawn = np.random.default_rng(0).normal(size=(max(0, LEAST_PIVOTS - len(points)), points.shape[1]))
    points = np.concatenate((points, drawn / np.sqrt((drawn**2).sum(axis=1, keepdims=True))))
    nearest = nearest_needed(points, sample, similarity, shared, recall)
    return sets.select("node", "vector").mapInArrow(describer(points, nearest), schema)


def lister(shared: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass from (node, pivots) to one row (node, key) for each set of `shared` reference points of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            points = np.sort(points, axis=1)
            chosen = np.array(list(combinations(range(points.shape[1]), shared))).reshape(-1, shared)
            keys = np.zeros((len(points), len(chosen)), dtype=np.int64)
            for place in range(shared):
                keys = (keys << POINT_BITS[shared]) + points[:, chosen[:, place]]
            nodes = np.repeat(batch.column(0).to_numpy(), len(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(keys.ravel())], names=["node", "key"])

    return run


def near_duplicate_vectors(
    df: DataFrame,
    similarity: float = SIMILARITY,
    shared: int = SHARED,
    recall: float = RECALL,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    list_rows: int = LIST_ROWS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are linked if the pivot index brings them together and their cosine, in double precision, is `similarity`
    or more. `n_links` counts the other vectors linked directly, `component_id` is the smallest id reachable by links,
    itself included, and `kept` says whether that is the vector's own.

    1. Equal vectors are one node from here on, however many there are.
    2. A node is described by its nearest reference points, nearest first; their number is set for `recall` of the
       pairs at the threshold (see `nearest_needed`).
    3. Inverted lists, one per set of `shared` reference points (2 or 3), retrieve all nodes that share at least so
       many. The number of points grows with the root of the number of vectors, so lists of vectors that are not
       similar stay short at any size. Lists with one node are dropped before vectors are sent.
    4. Lists are dealt to tasks of about `task_rows` postings; longer ones are hashed into blocks of about `list_rows`
       and each pair of blocks is a group of its own. A task compares pairs in chunks, each pair in one list only, and
       returns link counts and a forest, never the pairs.
    5. The forests are connected.

    The index is approximate: pairs above the threshold are found more often than those at it (see the README and the
    test); nothing below the threshold is linked. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without an id, link with nothing; vectors of different lengths are never linked. Rows that
    share an id are vectors of their own; equal ones link. Extra columns are not read.
    """
    if shared not in POINT_BITS:
        raise ValueError("lists are made of two or three of the nearest reference points")
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    good = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    # Two independent hashes stand for a vector: equal vectors meet on them.
    name = F.when(good, F.concat_ws("-", F.xxhash64("vector"), F.hash("vector"), F.xxhash64(F.lit(1), "vector")))
    named = rows.select("vec_id", name.alias("name"))
    sets = rows.where(good).groupBy(name.alias("name")).agg(
        F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies")
    )
    sets = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "vector_sets")
    described = materialize(describe(sets, similarity, shared, recall), "described")

    postings = described.select("node", "pivots").mapInArrow(lister(shared), "node long, key long")
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes.select("key", F.ceil(F.col("n") / list_rows).cast("int").alias("blocks"), "n"), "lists")
    n_tasks = max(1, math.ceil((sizes.agg(F.sum("n")).first()[0] or 0) / task_rows))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    live = postings.join(sizes, "key").select(
        "node",
        "key",
        block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with_block"),
        # A long list has a task of its own per pair of blocks, short ones share.
        F.when(F.col("blocks") > 1, F.xxhash64("key"))
        .otherwise(F.pmod(F.xxhash64("key"), F.lit(n_tasks)))
        .alias("task"),
    )
    placed = live.join(described, "node").join(sets.select("node", "copies"), "node").select(
        "task",
        F.least("block", "with_block").alias("low"),
        F.greatest("block", "with_block").alias("high"),
        "key",
        "node",
        "block",
        "copies",
        "pivots",
        "vector",
    )
    found = materialize(
        placed.groupBy("task", "low", "high").applyInArrow(
            verifier(similarity, shared), "node long, links long, other long"
        ),
        "links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = joined.select(F.col("id").alias("node"), "root")
    by_node = (
        sets.drop("vector")
        .join(links, "node", "left")
        .join(classes, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    smallest = by_node.groupBy("root").agg(F.min("first_id").alias("component"))
    by_name = by_node.join(smallest, "root").select(
        "name", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("all_links")
    )
    component = F.coalesce("component", "vec_id")
    return named.join(by_name, "name", "left").select(
        "vec_id",
        F.coalesce("all_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
