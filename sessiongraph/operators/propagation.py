"""Neighborhood aggregation of node vectors over the graph, as a product of blocks."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongraph.functions.blocks import matrix
from sessiongraph.functions.vectors import as_double
from sessiongraph.session import materialize, partitions_for, shuffle_partitions

Batches = Iterator[pa.RecordBatch]

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fewest nodes of a block, and edges of a chunk: one block of vectors meets so many edges out of it.
NODE_BLOCK = 4_096
EDGE_CHUNK = 65_536
# Numbers in the vectors of a block, which a task holds, and in the sums of a part, which it gives out at once.
BLOCK_NUMBERS = 3 << 22
PART_NUMBERS = 1 << 22
# Numbers that the edges of a chunk add up at most, and the number of chunks that a graph has before they grow.
CHUNK_NUMBERS = 12 << 24
CHUNKS = 32
# Edges that are packed at once, and edges for which there is a task that adds up partial sums.
PACKED_EDGES = 1 << 20
EDGES_PER_TASK = 1_000_000
# Numbers held for a slice of the edges while they are added up.
SLICE_NUMBERS = 4_000_000
_PARTIAL = pa.schema([("node_idx", pa.int64()), ("total", pa.list_(pa.float64())), ("n", pa.int64())])
# A piece: `n` edges, or vectors where `part` is -1, of a block. `src` and `dst` are whole numbers in as few bytes as
# they need: places in the block, and the steps between the targets from `low` on; `w` are doubles, one if all are alike.
_PACKED = pa.schema(
    [
        *[(name, pa.int64()) for name in ("block", "chunk", "part", "n", "low")],
        *[(name, pa.binary()) for name in ("src", "dst", "w")],
    ]
)
_PIECE = "block long, chunk long, part long, n long, low long, src binary, dst binary, w binary"


def in_bytes(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as many bytes each as the largest needs: first the low bytes of all, then the next."""
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def from_bytes(data: pa.Buffer, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    values = np.zeros((n, 8), np.uint8)
    values[:, : len(planes)] = planes.T
    return values.view("<i8").ravel()


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin and end."""
    begins = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return begins, np.append(begins[1:], len(keys))


def _pieces_of(edges: pa.Table, node_block: int, parts: int) -> pa.RecordBatch:
    src, dst, chunk = (edges[c].to_numpy() for c in ("src", "dst", "chunk"))
    w = edges["w"].to_numpy() if "w" in edges.column_names else np.broadcast_to(1.0, len(src))
    # Block, chunk and part in one number, which is small enough for the target beside it unless ids are huge.
    block, part = src // node_block, dst % parts
    lowest, most = int(block.min()), int(chunk.max()) + 1
    cell = ((block - lowest) * most + chunk) * parts + part
    first, span = int(dst.min()), int(dst.max()) - int(dst.min()) + 1
    if (int(cell.max()) + 1) * span < 1 << 62:
        order = np.argsort(cell * span + (dst - first))
    else:
        order = np.lexsort((dst, cell))
    cell, dst, w = cell[order], dst[order], w[order]
    begins, ends = _runs(cell)
    steps = np.diff(dst, prepend=dst[:1])
    steps[begins] = 0
    places = src[order] - (cell // (most * parts) + lowest) * node_block
    codes = []
    for a, b in zip(begins, ends, strict=True):
        weights = w[a:b]
        same = (weights == weights[0]).all()
        codes.append((in_bytes(places[a:b]), in_bytes(steps[a:b]), (weights[:1] if same else weights).tobytes()))
    heads = order[begins]
    numbers = [block[heads], chunk[heads], part[heads], ends - begins, dst[begins]]
    return pa.RecordBatch.from_arrays(
        [*[pa.array(x, pa.int64()) for x in numbers], *[pa.array(x, pa.binary()) for x in zip(*codes, strict=True)]],
        schema=_PACKED,
    )


def pack_edges(node_block: int, parts: int) -> Callable[[Batches], Batches]:
    """Arrow pass over (src, dst, chunk[, w]): edges of one block, chunk and part become one row."""
    packed_edges = PACKED_EDGES

    def run(batches: Batches) -> Batches:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= packed_edges:
                yield _pieces_of(pa.Table.from_batches(held), node_block, parts)
                held, n = [], 0
        if n:
            yield _pieces_of(pa.Table.from_batches(held), node_block, parts)

    return run


def pack_vectors(node_block: int) -> Callable[[Batches], Batches]:
    """Arrow pass over (node_idx, vector): the vectors of a batch that are of one block become one row."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch["node_idx"].to_numpy()
            block, vectors = nodes // node_block, matrix(pa.chunked_array([batch["vector"]]))
            order = np.argsort(block, kind="stable")
            rows = []
            for a, b in zip(*_runs(block[order]), strict=True):
                at = order[a:b]
                of = int(block[at[0]])
                rows.append((of, 0, -1, len(at), 0, in_bytes(nodes[at] - of * node_block), b"", vectors[at].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED
            )

    return run


def _partial_sums(
    pieces: list[tuple], vectors: np.ndarray, known: np.ndarray, step: int
) -> Iterator[pa.RecordBatch]:
    """Per target of the pieces the weighted sum of its sources' vectors and their number, in slices of `step` edges."""
    src = np.concatenate([from_bytes(p[1], p[0]) for p in pieces])
    dst = np.concatenate([p[4] + np.cumsum(from_bytes(p[2], p[0])) for p in pieces])
    weight = np.concatenate([np.broadcast_to(np.frombuffer(p[3], np.float64), p[0]) for p in pieces])
    order = np.argsort(dst, kind="stable")
    order = order[known[src[order]]]
    if not len(order):
        return
    dst, weight, src = dst[order], weight[order], src[order]
    first, _ = _runs(dst)
    counts = np.diff(first, append=len(dst))
    totals = np.zeros((len(first), vectors.shape[1]))
    for start in range(0, len(dst), step):
        part = slice(start, start + step)
        # The targets of the slice; the first of them may go on from the slice before.
        low = int(np.searchsorted(first, start, "right")) - 1
        high = int(np.searchsorted(first, start + step, "left"))
        begins = np.maximum(first[low:high] - start, 0)
        totals[low:high] += np.add.reduceat(vectors[src[part]] * weight[part, None], begins, axis=0)
    ends = np.arange(len(first) + 1, dtype=np.int32) * np.int32(vectors.shape[1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(dst[first]), pa.ListArray.from_arrays(ends, totals.ravel()), pa.array(counts)], schema=_PARTIAL
    )


def block_products(node_block: int) -> Callable[[Batches], Batches]:
    """Arrow pass over pieces sorted by block, chunk and part: per target the weighted sum and the number of its edges.

    The vectors of a block come first and are held; its edges are read and added up part by part. Edges whose source
    has no vector are left out.
    """
    slice_numbers = SLICE_NUMBERS

    def run(batches: Batches) -> Batches:
        cell, part, pieces, vectors, known = None, None, [], None, None

        def sums() -> Batches:
            if pieces and vectors is not None:
                yield from _partial_sums(pieces, vectors, known, max(1, slice_numbers // vectors.shape[1]))

        for batch in batches:
            numbers = [batch[c].to_pylist() for c in ("block", "chunk", "part", "n", "low")]
            codes = [batch[c] for c in ("src", "dst", "w")]
            for i, (block, chunk, of, n, low) in enumerate(zip(*numbers, strict=True)):
                if (block, chunk) != cell or of != part:
                    yield from sums()
                    part, pieces = of, []
                if (block, chunk) != cell:
                    cell, vectors, known = (block, chunk), None, None
                src, dst, w = (c[i].as_buffer() for c in codes)
                if of >= 0:
                    pieces.append((n, src, dst, w, low))
                    continue
                rows = np.frombuffer(w, np.float64).reshape(n, -1)
                if vectors is None and rows.shape[1]:
                    # Pages that no vector is written to take no memory.
                    vectors, known = np.empty((node_block, rows.shape[1])), np.zeros(node_block, bool)
                if vectors is not None:
                    places = from_bytes(src, n)
                    vectors[places], known[places] = rows, True
        yield from sums()

    return run


def added_weights(batches: Batches) -> Batches:
    """Arrow pass over pieces of edges: (node_idx, w), the weights of a piece added up per target."""
    for batch in batches:
        for low, n, steps, w in zip(*(batch[c] for c in ("low", "n", "dst", "w")), strict=True):
            n = n.as_py()
            dst = low.as_py() + np.cumsum(from_bytes(steps.as_buffer(), n))
            weights = np.broadcast_to(np.frombuffer(w.as_buffer(), np.float64), n)
            first, _ = _runs(dst)
            sums = np.add.reduceat(weights, first)
            yield pa.RecordBatch.from_arrays([pa.array(dst[first]), pa.array(sums)], names=["node_idx", "w"])


def _width(vectors: DataFrame, column: str) -> int:
    """The number of components of the vectors, which are all equally long; 0 if there are none."""
    row = vectors.select(F.size(column)).first()
    return 0 if row is None else row[0]


def _shape(width: int, nodes: int, edges: int) -> dict[str, int]:
    """Sizes of blocks and chunks for vectors of a width, in a graph of so many nodes and edges.

    What travels in a hop is each vector once per chunk of its block and each target once per block that has edges to
    it, so a graph is cut into few cells, and about as many blocks as chunks of a block.
    """
    most = max(EDGE_CHUNK, CHUNK_NUMBERS // max(width, 12))
    edge_chunk = min(most, max(EDGE_CHUNK, -(-edges // CHUNKS)))
    blocks = math.isqrt(max(0, -(-edges // edge_chunk) - 1)) + 1
    node_block = max(NODE_BLOCK, min(BLOCK_NUMBERS // max(width, 1), -(-nodes // blocks)))
    return {"node_block": -(-node_block // NODE_BLOCK) * NODE_BLOCK, "edge_chunk": edge_chunk}


def _edge_counts(edges: DataFrame, unit: int = NODE_BLOCK) -> DataFrame:
    """(unit, n), stored: the number of edges out of each `unit` nodes."""
    counts = edges.groupBy(F.floor(F.col("src") / F.lit(unit)).alias("unit")).agg(F.count("*").alias("n"))
    return materialize(counts, "edge_counts", lean=True)


def blocked_edges(
    edges: DataFrame,
    node_block: int = NODE_BLOCK,
    edge_chunk: int = EDGE_CHUNK,
    counts: DataFrame | None = None,
    unit: int = NODE_BLOCK,
) -> DataFrame:
    """(src, dst[, w], block, chunk, chunks): edges by block of their source, large blocks in hashed chunks.

    A source with very many edges fills several chunks, each a task of its own. All edges of a block to one target are
    in one chunk, so that a block gives one partial sum per target; such edges are few, one from each node of the block.
    `counts`, where it is known, is the number of edges per `unit` nodes, of which a block holds a whole number.
    """
    if counts is None:
        counts, unit = _edge_counts(edges, node_block), node_block
    per_block = counts.groupBy(F.floor(F.col("unit") / F.lit(node_block // unit)).alias("block")).agg(F.sum("n").alias("n"))
    sizes = per_block.select("block", F.ceil(F.col("n") / F.lit(edge_chunk)).cast("int").alias("chunks"))
    placed = edges.withColumn("block", F.floor(F.col("src") / F.lit(node_block)))
    chunk = F.pmod(F.xxhash64("dst"), F.col("chunks")).cast("int").alias("chunk")
    return placed.join(materialize(sizes, "edge_blocks"), "block").select(*edges.columns, "block", chunk, "chunks")


def packed_edges(blocked: DataFrame, node_block: int = NODE_BLOCK, parts: int = 1) -> DataFrame:
    """Edges of `blocked_edges` in pieces: an edge takes a few bytes. The targets of a chunk are cut into `parts`."""
    weight = [c for c in blocked.columns if c == "w"]
    return blocked.select("src", "dst", F.col("chunk").cast("long").alias("chunk"), *weight).mapInArrow(
        pack_edges(node_block, parts), _PIECE
    )


def _products(packed: DataFrame, vectors: DataFrame, node_block: int, cells: int = 0) -> DataFrame:
    """(node_idx, total, n): partial sums per target over all blocks of sources.

    A block of vectors goes to each chunk of its edges; edges travel in pieces and never meet a vector in a join. A
    target comes out of each block as one partial row. A chunk is one task.
    """
    blocks = packed.groupBy("block").agg((F.max("chunk") + 1).alias("of_chunks"))
    sources = vectors.select("node_idx", as_double(F.col("vector")).alias("vector"))
    sent = sources.mapInArrow(pack_vectors(node_block), _PIECE).join(F.broadcast(blocks), "block")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("of_chunks") - 1)).alias("chunk")
    sent = sent.select(*[chunk if c == "chunk" else F.col(c) for c in _PACKED.names])
    parts = max(shuffle_partitions(packed.sparkSession), 3 * cells)
    return (
        packed.unionByName(sent)
        .repartition(parts, "block", "chunk")
        .sortWithinPartitions("block", "chunk", "part")
        .mapInArrow(block_products(node_block), "node_idx long, total array<double>, n long")
    )


def _sums(blocked: DataFrame, vectors: DataFrame, node_block: int = NODE_BLOCK) -> DataFrame:
    """`_products` of edges that are not packed yet."""
    return _products(packed_edges(blocked, node_block), vectors, node_block)


def _added(rows: DataFrame, width: int | None = None, parts: int | None = None) -> DataFrame:
    """(node_idx, total, n) added up per node, one plain sum per component of the vectors."""
    width = _width(rows, "total") if width is None else width
    dealt = rows if parts is None else rows.repartition(parts, "node_idx")
    sums = dealt.groupBy("node_idx").agg(
        *[F.sum(F.col("total")[i]).alias(f"_x{i}") for i in range(width)], F.sum("n").alias("n")
    )
    return sums.select("node_idx", F.array(*[f"_x{i}" for i in range(width)]).cast("array<double>").alias("total"), "n")


def _scaled(vector: Column, factor: Column) -> Column:
    return F.transform(as_double(vector), lambda x: x * factor)


def _scales(packed: DataFrame) -> DataFrame:
    """(node_idx, scale): one over the root of the weight of each node's edges."""
    weights = packed.select("low", "n", "dst", "w").mapInArrow(added_weights, "node_idx long, w double")
    return weights.groupBy("node_idx").agg((1 / F.sqrt(F.sum("w"))).alias("scale"))


@dataclass(frozen=True)
class _Graph:
    """The stored edges of a graph, cut for vectors of a width."""

    packed: DataFrame
    node_block: int
    cells: int
    parts: int

    def sums(self, vectors: DataFrame) -> DataFrame:
        return _products(self.packed, vectors, self.node_block, self.cells)


def _graph(edges: DataFrame, width: int) -> _Graph:
    """`edges` is (src, dst[, w])."""
    counts = _edge_counts(edges)
    last, n = counts.agg(F.max("unit"), F.sum("n")).first()
    shape = _shape(width, (max(last or 0, 0) + 1) * NODE_BLOCK, n or 0)
    parts = -(-shape["edge_chunk"] * max(width, 12) // PART_NUMBERS)
    packed = packed_edges(blocked_edges(edges, **shape, counts=counts), shape["node_block"], parts)
    return _Graph(
        materialize(packed, "packed_edges", lean=True),
        shape["node_block"],
        -(-(n or 0) // shape["edge_chunk"]),
        partitions_for(edges.sparkSession, n or 0, EDGES_PER_TASK),
    )


def normalized_sum(edges: DataFrame, vectors: DataFrame, weighted: bool = False) -> DataFrame:
    """Symmetric-normalized neighborhood sum with self-loops: D^-1/2 (A + I) D^-1/2 X.

    `edges` is (src, dst[, weight]) with both directions present, `vectors` is (node_idx, vector). The scaling is done
    on the vectors before and after the product, so edges are never joined with degrees.
    """
    return propagate(edges, vectors, 1, weighted)


def neighbor_mean(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean of the neighbors' vectors; nodes without neighbors are absent."""
    width = _width(vectors, "vector")
    graph = _graph(edges.select("src", "dst"), width)
    sums = _added(graph.sums(vectors), width, graph.parts)
    return sums.select("node_idx", _scaled(F.col("total"), 1 / F.col("n")).alias("vector"))


def propagate(edges: DataFrame, vectors: DataFrame, hops: int, weighted: bool = False) -> DataFrame:
    """`normalized_sum` repeated over the same packed edges; each hop but the last is stored, so plans do not pile up."""
    current = vectors.select("node_idx", "vector")
    if not hops:
        return current
    width = _width(vectors, "vector")
    weight, one = ([F.col("weight").cast("double").alias("w")], [F.lit(1.0).alias("w")]) if weighted else ([], [])
    loops = vectors.select(F.col("node_idx").alias("src"), F.col("node_idx").alias("dst"), *one)
    graph = _graph(edges.select("src", "dst", *weight).unionByName(loops), width)
    scales = materialize(_scales(graph.packed), "scales", lean=True)
    scale = F.col("scale")
    scaled = current.join(scales, "node_idx").select("node_idx", _scaled(F.col("vector"), scale).alias("vector"))
    for hop in range(1, hops + 1):
        sums = _added(graph.sums(scaled), width, graph.parts).join(scales, "node_idx")
        if hop < hops:
            # Scaled for the end of this hop and the start of the next.
            scaled = sums.select("node_idx", _scaled(F.col("total"), scale * scale).alias("vector"))
            scaled = materialize(scaled, "hop", lean=True)
    return sums.select("node_idx", _scaled(F.col("total"), scale).alias("vector"))
