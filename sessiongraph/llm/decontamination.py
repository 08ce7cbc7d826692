"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.llm.common import (
    PUNCTUATION,
    grams,
    kept_rows,
    lowered,
    separator_table,
    slices,
    text_pass,
    word_hashes,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_MATCH = 5
COVERAGE = 0.5
# Benchmark text shipped to the executors at once; a larger benchmark takes several passes.
BLOCK_BYTES = 8_000_000
# Pairs of equal runs held at once: a repeated token makes as many as the product of its places.
SEED_PAIRS = 1_000_000


def tiles(matches: list[tuple[int, int, int]], min_match: int, size: int | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: again and again the longest match of unmarked tokens is marked.

    `matches` are all maximal runs (document start, item start, length). Among equally long ones the one first
    in the item, then first in the document, goes first. What marked tokens cut off a run competes anew, if
    it has `min_match` tokens or more. Nothing is left to find once fewer of the item's
    `size` tokens, if given, are unmarked.
    """
    agenda = [(-length, item, document) for document, item, length in matches]
    heapq.heapify(agenda)
    used_document: set[int] = set()
    used_item: set[int] = set()
    out = []
    while agenda and (size is None or size - len(used_item) >= min_match):
        length, item, document = heapq.heappop(agenda)
        length = -length
        free = [document + k not in used_document and item + k not in used_item for k in range(length)]
        if all(free):
            used_document.update(range(document, document + length))
            used_item.update(range(item, item + length))
            out.append((document, item, length))
            continue
        start = None
        for k, is_free in enumerate([*free, False]):
            if is_free and start is None:
                start = k
            elif not is_free and start is not None:
                if k - start >= min_match:
                    heapq.heappush(agenda, (start - k, item + start, document + start))
                start = None
    return out


class Seeds:
    """Hashes of the runs of `width` tokens of a set of items, with their places."""

    def __init__(self, items: list[np.ndarray], width: int) -> None:
        self.width = width
        hashes = [grams(tokens, width) for tokens in items]
        self.owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        self.place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.empty(0, dtype=np.int64)])
        values = np.concatenate(hashes or [np.empty(0, dtype=np.uint64)])
        order = np.argsort(values, kind="stable")
        self.owner, self.place, self.values = self.owner[order], self.place[order], values[order]
        # Twice as many bits as values and more: most runs are told apart by one look.
        self.bits = max(16, int(np.ceil(np.log2(len(values) + 1))) + 4)
        self.present = np.zeros(1 << self.bits, dtype=bool)
        self.present[values & np.uint64((1 << self.bits) - 1)] = True

    def places(
        self, rolled: np.ndarray, limit: int = SEED_PAIRS
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document place, item, item place) of all equal runs, in document order and about `limit` at once."""
        at = np.flatnonzero(self.present[rolled & np.uint64((1 << self.bits) - 1)])
        low = np.searchsorted(self.values, rolled[at], "left")
        count = np.searchsorted(self.values, rolled[at], "right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        ends = np.cumsum(count)
        start = 0
        while start < len(at):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit)))
            n = count[start:stop]
            entry = np.repeat(low[start:stop] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield np.repeat(at[start:stop], n), self.owner[entry], self.place[entry]
            start = stop


def joined(
    document: np.ndarray, owner: np.ndarray, at: np.ndarray, place: np.ndarray, length: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Runs that follow each other on one diagonal of a document and an item as one; sorted by document and item."""
    order = np.lexsort((at, at - place, owner, document))
    document, owner, at, place, length = (x[order] for x in (document, owner, at, place, length))
    fresh = np.ones(len(at), dtype=bool)
    same = (np.diff(document) == 0) & (np.diff(owner) == 0) & (np.diff(at - place) == 0)
    fresh[1:] = ~(same & (at[:-1] + length[:-1] == at[1:]))
    starts = np.flatnonzero(fresh)
    if len(starts):
        length = np.add.reduceat(length, starts)
    return document[starts], owner[starts], at[starts], place[starts], length


def maximal_runs(seeds: Seeds, rolled: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, item, document start, item start, length in tokens) of all maximal runs of equal tokens.

    Seeds are chained into runs piece by piece and runs that meet at the border of two pieces are joined, so memory
    grows with the runs and not with the seeds of a repeated token.
    """
    pieces = []
    for at, owner, place in seeds.places(rolled):
        document = np.searchsorted(offsets, at, "right") - 1
        inside = at + seeds.width <= offsets[document + 1]
        kept = (document[inside], owner[inside], at[inside], place[inside])
        pieces.append(joined(*kept, np.ones(len(kept[0]), dtype=np.int64)))
    if not pieces:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    document, owner, at, place, length = joined(*(np.concatenate(column) for column in zip(*pieces, strict=True)))
    return document, owner, at, place, length + seeds.width - 1


def tiler(items: list[tuple[int, str]], min_match: int, coverage: float) -> Callable[[list, list], dict]:
    """The batch function: pairs of a document and an item whose tokens are covered enough."""
    separators = separator_table(PUNCTUATION)
    tokens = [word_hashes([lowered(text)], separators)[0] for _, text in items]
    names = [name for name, _ in items]
    by_width: dict[int, list[int]] = {}
    for i, words in enumerate(tokens):
        if len(words):
            by_width.setdefault(min(min_match, len(words)), []).append(i)
    seeds = [(Seeds([tokens[i] for i in group], width), group) for width, group in sorted(by_width.items())]

    def tile(ids: list, texts: list) -> dict:
        out: dict[str, list] = {c: [] for c in ("doc_id", "item_id", "coverage", "matched", "n_tiles", "n_tokens")}
        for first, part in slices(map(lowered, texts)):
            hashes, offsets = word_hashes(part, separators)
            for seed, group in seeds:
                rolled = grams(hashes, seed.width)
                document, owner, at, place, length = maximal_runs(seed, rolled, offsets)
                edges = np.flatnonzero((np.diff(document) != 0) | (np.diff(owner) != 0)) + 1
                for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                    if start == stop:
                        continue
                    item = group[owner[start]]
                    size = len(tokens[item])
                    # Tokens in no run cannot be covered: a bound that spares most pairs the tiling.
                    borders = np.zeros(size + 1, dtype=np.int64)
                    np.add.at(borders, place[start:stop], 1)
                    np.add.at(borders, place[start:stop] + length[start:stop], -1)
                    if np.count_nonzero(np.cumsum(borders[:-1])) < coverage * size:
                        continue
                    runs = [x[start:stop].tolist() for x in (at, place, length)]
                    found = tiles(list(zip(*runs, strict=True)), seed.width, size)
                    matched = sum(length for _, _, length in found)
                    if matched >= coverage * size:
                        row = ids[first + int(document[start])], names[item], matched / size, matched, len(found), size
                        for column, value in zip(out, row, strict=True):
                            out[column].append(value)
        return out

    return tile


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about `limit` text bytes, fetched partition by partition."""
    held, size = [], 0
    rows = benchmark.select(id_column, text_column).where(F.col(text_column).isNotNull())
    for item, text in rows.distinct().toLocalIterator():
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    if held:
        yield held


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pairs of a document and a benchmark item with at least `coverage` of the item's tokens in tiles.

    Returns doc_id, item_id, coverage, matched (tokens), n_tiles, n_tokens (of the item). Tokens are runs of
    letters and digits of the lower-cased text (any non-ASCII character counts as a letter). Runs of
    `min_match` tokens are seeds, found by rolling hashes; runs of seeds on a diagonal are the maximal
    matches, and greedy string tiling marks the longest ones until none is left. Tiles may come in any order,
    so a passage with its sentences shuffled is found. Items of fewer tokens must occur as a whole.

    Null and empty texts and items give no pairs. Rows that share an id are checked one by one. The documents
    are not shuffled: the benchmark comes to them in blocks of at most `block_bytes` of text, one pass each.
    """
    schema = "doc_id long, item_id long, coverage double, matched int, n_tiles int, n_tokens int"
    passes = [
        text_pass(df, tiler(block, min_match, coverage), schema, id_column, text_column)
        for block in _blocks(benchmark, item_id_column, item_text_column, block_bytes)
    ]
    if not passes:
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, passes)


def without_contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`df` without the documents that hold a benchmark item. Each row is judged by its own text in the pass that reads
    it, so rows that share an id, or have none, do not go with each other."""

    def free_of(block: list[tuple[int, str]]) -> Callable[[list], np.ndarray]:
        tile = tiler(block, min_match, coverage)

        def keeps(texts: list) -> np.ndarray:
            free = np.ones(len(texts), dtype=bool)
            free[tile(list(range(len(texts))), texts)["doc_id"]] = False
            return free

        return keeps

    for block in _blocks(benchmark, item_id_column, item_text_column, block_bytes):
        df = kept_rows(df, free_of(block), text_column)
    return df
