"""Ranked search over word counts: posting lists cut into blocks of similar documents, skipped by exact bounds."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessiongraph.llm.common import PUNCTUATION, text_pass
from sessiongraph.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Text of the queries that one pass over the documents answers; the driver and each task hold one such block.
QUERY_BYTES = 4_000_000
# Documents of one part of the index, and the cells of its document by term table.
PART_DOCUMENTS, PART_CELLS = 4_096, 16_000_000
# Postings of a block on average.
BLOCK_POSTINGS = 64
# Documents that give the first bounds; they are searched with all others too.
BOUND_DOCUMENTS = 4_096
SKETCH = 64
CHUNK = 4_000_000

_SPACED = bytes(
    0x20 if b in PUNCTUATION else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, as lists of bounded size: runs of other bytes than ASCII ones that are no letter
    or digit, with A-Z lower-cased."""
    spaced = text.translate(_SPACED)
    start = 0
    while start < len(spaced):
        stop = spaced.find(b" ", start + CHUNK)
        stop = len(spaced) if stop < 0 else stop
        yield spaced[start:stop].split()
        start = stop


def term_counts(terms: dict[bytes, int]) -> Callable[[list, list], dict]:
    """The batch function of the counting pass: terms of each text, and the counts of those in `terms`."""

    def count(ids: list, texts: list) -> dict:
        sizes, numbers, counts = [], [], []
        for text in texts:
            size, found = 0, Counter()
            for words in words_of(text.encode() if text else b""):
                size += len(words)
                found.update(w for w in words if w in terms)
            sizes.append(size)
            numbers.append([terms[w] for w in found])
            counts.append(list(found.values()))
        return {"doc_id": ids, "n": sizes, "terms": numbers, "tfs": counts}

    return count


class Part:
    """A part of the index: the documents' weights per term, and per term the documents that hold it.

    `values[e]` belongs to document `rows[e]` and term `terms[e]`; entries are ordered by document.
    """

    def __init__(
        self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray
    ) -> None:
        self.ids, self.terms, self.values, self.weights = ids, terms, values, weights
        self.first = np.searchsorted(rows, np.arange(len(ids) + 1))
        by_term = np.argsort(terms, kind="stable")
        self.listed = rows[by_term]
        self.list_first = np.searchsorted(terms[by_term], np.arange(len(weights) + 1))
        self.table = np.zeros((len(ids), len(weights)), dtype=np.int32)
        self.table[rows, terms] = values
        self.highest = self.table.max(axis=0).astype(np.int64)
        # Signed sums over hashed terms keep the angles between documents well enough to tell clusters.
        draw = np.random.default_rng(0)
        place, sign = draw.integers(SKETCH, size=len(weights)), draw.choice((-1.0, 1.0), size=len(weights))
        sketch = np.bincount(
            rows * SKETCH + place[terms],
            weights=sign[terms] * values * weights[terms].astype(np.float64),
            minlength=len(ids) * SKETCH,
        ).reshape(len(ids), SKETCH)
        length = np.sqrt((sketch**2).sum(axis=1, keepdims=True))
        self.sketch = (sketch / np.where(length > 0, length, 1)).astype(np.float32)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, block of each, summaries) of a posting list.

        Documents go to the most similar one of evenly chosen members of the list. The summary of a block holds the
        highest value of any of its documents in every term.
        """
        documents = self.listed[self.list_first[term] : self.list_first[term + 1]]
        n_blocks = -(-len(documents) // BLOCK_POSTINGS)
        block = np.zeros(len(documents), dtype=np.int64)
        if n_blocks > 1:
            centers = documents[np.arange(n_blocks) * len(documents) // n_blocks]
            block = (self.sketch[documents] @ self.sketch[centers].T).argmax(axis=1)
        sizes = self.first[documents + 1] - self.first[documents]
        stop = np.cumsum(sizes)
        entries = np.arange(int(sizes.sum())) + np.repeat(self.first[documents] - (stop - sizes), sizes)
        summaries = np.zeros(n_blocks * len(self.weights), dtype=np.int32)
        np.maximum.at(summaries, np.repeat(block, sizes) * len(self.weights) + self.terms[entries], self.values[entries])
        return documents, block, summaries.reshape(n_blocks, -1)

    def search(self, queries: Sequence[np.ndarray], least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of all documents that may have a score of `least[query]` or more.

        Lists whose terms together cannot reach it are left out, for a document in none of the others cannot either.
        Of the others, blocks are left out only if the summary's score, which no document of the block exceeds, is
        lower. Documents of the blocks left are scored in full.
        """
        asking: dict[int, list[int]] = {}
        for number, terms in enumerate(queries):
            bound = self.weights[terms] * self.highest[terms]
            order = np.argsort(bound, kind="stable")
            for term in terms[order[np.cumsum(bound[order]) >= least[number]]].tolist():
                asking.setdefault(term, []).append(number)
        open_to = np.zeros((len(queries), len(self.ids)), dtype=bool)
        for term, numbers in asking.items():
            documents, block, summaries = self.blocks(term)
            for number in numbers:
                terms = queries[number]
                reach = summaries[:, terms].astype(np.int64) @ self.weights[terms]
                open_to[number, documents[(reach >= least[number])[block]]] = True
        for number, terms in enumerate(queries):
            rows = np.flatnonzero(open_to[number])
            if len(rows):
                yield number, self.ids[rows], self.table[np.ix_(rows, terms)].astype(np.int64) @ self.weights[terms]


def searcher(
    items: Sequence[int],
    queries: Sequence[np.ndarray],
    weights: np.ndarray,
    least: np.ndarray,
    totals: tuple[int, int],
    k: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass over counted documents: builds part after part, and keeps the k best of each query it has met."""
    n_documents, n_terms = totals
    per_part = max(1, min(PART_DOCUMENTS, PART_CELLS // max(len(weights), 1)))

    def part_of(batch: pa.Table) -> Part:
        lists = batch["terms"].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        rows = np.repeat(np.arange(batch.num_rows), sizes)
        tf = batch["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        norm = 100 - 90 + 90 * batch["n"].to_numpy().astype(np.int64) * n_documents // n_terms
        values = 1_000_000_000 * tf // (1000 * tf + 8 * norm[rows])
        terms = lists.flatten().to_numpy().astype(np.int64)
        return Part(batch["doc_id"].to_numpy(), rows, terms, values.astype(np.int32), weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids = [np.empty(0, dtype=np.int64) for _ in queries]
        best_scores = [np.empty(0, dtype=np.int64) for _ in queries]
        wanted = least.copy()

        def add(table: pa.Table) -> None:
            for number, ids, scores in part_of(table).search(queries, wanted):
                ids, scores = np.concatenate((best_ids[number], ids)), np.concatenate((best_scores[number], scores))
                kept = np.lexsort((ids, -scores))[:k]
                kept = kept[scores[kept] > 0]
                best_ids[number], best_scores[number] = ids[kept], scores[kept]
                if len(kept) == k:
                    wanted[number] = max(wanted[number], scores[kept[-1]])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                taken = batch.slice(start, per_part - rows)
                held.append(taken)
                start, rows = start + taken.num_rows, rows + taken.num_rows
                if rows == per_part:
                    add(pa.Table.from_batches(held))
                    held, rows = [], 0
        if held:
            add(pa.Table.from_batches(held))
        sizes = [len(ids) for ids in best_ids]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(items, dtype=np.int64), sizes)),
                pa.array(np.concatenate(best_ids or [np.empty(0, dtype=np.int64)])),
                pa.array(np.concatenate(best_scores or [np.empty(0, dtype=np.int64)])),
            ],
            names=["item_id", "doc_id", "score"],
        )

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_block(documents: DataFrame, items: dict[int, set[bytes]], k: int) -> DataFrame:
    """The k best documents of each of the given items, stored."""
    spark = documents.sparkSession
    terms = {term: number for number, term in enumerate(sorted(set().union(*items.values())))}
    shared = spark.sparkContext.broadcast(terms)
    counted = materialize(
        text_pass(
            documents,
            lambda ids, texts: term_counts(shared.value)(ids, texts),
            "doc_id long, n long, terms array<int>, tfs array<int>",
            "doc_id",
            "text",
        ),
        "term_counts",
    )
    n_documents, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(terms), dtype=np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[term] = n
    weights = np.array(
        [math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1))) for df in holding.tolist()], dtype=np.int64
    )
    names = sorted(items)
    numbers = [np.array(sorted(terms[t] for t in items[name]), dtype=np.int64) for name in names]
    queries = [n[(weights[n] > 0) & (holding[n] > 0)] for n in numbers]
    schema = "item_id long, doc_id long, score long"
    usable = counted.where("doc_id is not null and size(terms) > 0").select("doc_id", "n", "terms", "tfs")

    def best(rows: DataFrame, least: np.ndarray) -> DataFrame:
        run = searcher(names, queries, weights, least, (n_documents, n_terms), k)
        return _ranked(rows.mapInArrow(run, schema), k)

    least = np.ones(len(names), dtype=np.int64)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_documents // BOUND_DOCUMENTS)))
    place = {name: number for number, name in enumerate(names)}
    for row in best(usable.where(share == 0), least).where(F.col("rank") == k).collect():
        least[place[row.item_id]] = row.score
    found = materialize(best(usable, least), "found")
    shared.destroy()
    return found


def rank_documents(
    documents: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item, all if fewer.

    Terms are runs of letters, digits and bytes beyond ASCII with A-Z lower-cased. With N documents that hold a term,
    L terms in all, n terms in a document, df documents holding a term and tf its occurrences in one: the weight of a
    term is floor(1000 ln((2N + 2) / (2df + 1))), a document's m is 10 + 90nN div L, and its score sums
    weight * (10^9 tf div (1000 tf + 8m)) over the item's distinct terms. Equal scores go to smaller ids.

    1. Items are taken in blocks of about `query_bytes` of text; each is one pass over the documents.
    2. The pass counts the block's terms in every whole text; the counts are stored and give N, L and df.
    3. Tasks read the counts in parts of bounded size. In a part the posting list of each term is clustered into
       blocks of similar documents with coordinatewise highest values as summaries (see `Part`). A block is skipped
       only if its summary scores less than the k-th best score known: of the documents the task has met, and of a
       bounded number of documents searched first. That is exact; nothing is shuffled but k rows per item and task.

    Null text has no terms, like text without any. Documents without an id count in N, L and df but are not ranked;
    rows that share an id are documents of their own. Items without an id are left out; rows that share one are one
    item with the terms of all. Extra columns are not read. Empty tables give no rows.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    asked = items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text_column).alias("text"))
    asked = asked.where("item_id is not null and text <> ''")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(total / query_bytes))
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(n_blocks):
        chosen: dict[int, set[bytes]] = {}
        for row in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).toLocalIterator():
            chosen.setdefault(row.item_id, set()).update(w for words in words_of(row.text.encode()) for w in words)
        if chosen:
            result = result.unionByName(_search_block(texts, chosen, k))
    return result
