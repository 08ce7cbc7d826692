"""Phrases after their contexts: a table of what followed the last words, which grows with the corpus, and the chances
of its favourites."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongraph.llm.common import SLICE_BYTES, mix, parts, separator_table, word_hashes
from sessiongraph.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words that make up a context.
CONTEXT = 4
# One word in so many ends a phrase.
PHRASE_WORDS = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xA24BAED4963EE407)

# Counts are told apart by half powers of two; 2**45 is beyond any count.
GRADES_PER_DOUBLING = 2
GRADES = GRADES_PER_DOUBLING * 45
# Weight sets of the decision's mixer, by what the context has seen.
GATES = 6
STEPS = 200
RATE = 0.5


@dataclass
class Cut:
    """Phrases of several texts, in order: the text, the first word (counted over all texts), hashes of the phrase
    and of the words before it, and whether there are enough of those."""

    owner: np.ndarray
    start: np.ndarray
    phrase: np.ndarray
    context: np.ndarray
    has_context: np.ndarray


def cut(hashes: np.ndarray, sizes: np.ndarray) -> Cut:
    """Cut texts of `sizes` words after every word whose hash says so, and at their ends. Equal runs of words are cut
    alike wherever they lie. The end of a text is part of its last phrase."""
    n = len(hashes)
    if not n:
        empty = np.empty(0, dtype=np.int64)
        return Cut(empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    closes = (hashes >> np.uint64(40)) % np.uint64(PHRASE_WORDS) == 0
    last = (first + sizes - 1)[sizes > 0]
    closes[last] = True
    start = np.concatenate(([0], np.flatnonzero(closes)[:-1] + 1))
    length = np.diff(np.concatenate((start, [n])))
    is_last = np.zeros(n, dtype=bool)
    is_last[last] = True
    # Positions inside the phrase weigh its words, so their order counts.
    place = np.arange(n) - np.repeat(start, length)
    weights = mix(place.astype(np.uint64) + np.uint64(77)) | np.uint64(1)
    phrase = np.add.reduceat(hashes * weights, start)
    phrase = mix(phrase + np.where(is_last[start + length - 1], _END, np.uint64(0)))
    context = np.zeros(len(start), dtype=np.uint64)
    for k in range(1, CONTEXT + 1):
        context = context * _MULTIPLIER + hashes[np.maximum(start - k, 0)]
    return Cut(owner[start], start, phrase, mix(context), start - first[owner[start]] >= CONTEXT)


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, phrase, n) of all texts, added up within a slice of texts."""
    gap = separator_table()
    for batch in batches:
        for part in parts(batch, column=0, limit=SLICE_BYTES):
            texts = [t.encode("utf-8", "replace").lower() if t else b"" for t in part.column(0).to_pylist()]
            hashes, offsets = word_hashes(texts, gap)
            found = cut(hashes, np.diff(offsets))
            keyed = found.has_context
            pairs = np.stack((found.context[keyed], found.phrase[keyed]), axis=1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            fresh = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))[: len(pairs)])
            times = np.diff(np.concatenate((fresh, [len(pairs)]))) if len(pairs) else np.empty(0, dtype=np.int64)
            columns = [np.ascontiguousarray(pairs[fresh, 0]).view(np.int64), np.ascontiguousarray(pairs[fresh, 1]).view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1]), pa.array(times, pa.int64())],
                names=["context", "phrase", "n"],
            )


def grade(count: Column) -> Column:
    return F.floor(F.log2(count + 1) * GRADES_PER_DOUBLING).cast("int")


@dataclass
class Phrases:
    """(context, favourite, n, total) of all contexts, and (n_grade, total_grade, chance) of all grades."""

    favourites: DataFrame
    chances: DataFrame


def learn(texts: DataFrame) -> Phrases:
    """What followed each context of four words in the `text` of all rows: the most frequent phrase (ties to the larger
    hash), how often it did, and how often the context occurred. The chance that it follows again is learned from the
    same occurrences, each of them predicted from all others.

    Null and empty texts add nothing; of an empty table both tables still hold the right columns.
    """
    spark = texts.sparkSession
    pairs = texts.select("text").mapInArrow(pairs_of, "context long, phrase long, n long")
    pairs = pairs.groupBy("context", "phrase").agg(F.sum("n").alias("n"))
    favourites = pairs.groupBy("context").agg(
        F.sum("n").alias("total"), F.max(F.struct("n", "phrase")).alias("_most")
    )
    favourites = favourites.select("context", F.col("_most.phrase").alias("favourite"), F.col("_most.n").alias("n"), "total")
    favourites = materialize(favourites, "favourites")
    left = F.col("total") - 1
    cases = F.array(
        F.struct((F.col("n") - 1).alias("n"), left.alias("total"), F.lit(1).alias("hit"), F.col("n").alias("times")),
        F.struct(F.col("n"), left.alias("total"), F.lit(0).alias("hit"), (F.col("total") - F.col("n")).alias("times")),
    )
    seen = (
        favourites.where(F.col("total") > 1)
        .select(F.explode(cases).alias("_c"))
        .select("_c.*")
        .where((F.col("n") > 0) & (F.col("times") > 0))
        .groupBy(grade(F.col("n")).alias("n_grade"), grade(F.col("total")).alias("total_grade"))
        .agg(
            F.sum(F.col("hit") * F.col("times")).cast("double").alias("hits"),
            F.sum("times").cast("double").alias("times"),
        )
    )
    cells = [(r["n_grade"], r["total_grade"], r["hits"], r["times"]) for r in seen.collect()]
    rows = [(i, j, p) for (i, j), p in chances(cells).items()]
    return Phrases(favourites, spark.createDataFrame(rows, "n_grade int, total_grade int, chance double"))


def _gate(total_grade: int) -> int:
    return min(total_grade // GRADES_PER_DOUBLING, GATES) - 1


def chances(cells: list[tuple[int, int, float, float]]) -> dict[tuple[int, int], float]:
    """The chance of the favourite for every pair of grades: a mixed one (the log odds of the counts and a bias, weighed
    by gate, by descent on the coding cost), refined by what happened at these very grades."""

    def odds(i: int, j: int) -> np.ndarray:
        n, total = 2 ** (i / GRADES_PER_DOUBLING) - 1, 2 ** (j / GRADES_PER_DOUBLING) - 1
        return np.array([math.log((n + 0.4) / (max(total - n, 0) + 0.4)), 1.0])

    weights = np.tile(np.array([0.7, 0.0]), (GATES, 1))
    total_of = np.zeros(GATES)
    for _, j, _, times in cells:
        total_of[_gate(j)] += times
    for _ in range(STEPS):
        slopes = np.zeros_like(weights)
        for i, j, hits, times in cells:
            x = odds(i, j)
            p = 1 / (1 + math.exp(-float(weights[_gate(j)] @ x)))
            slopes[_gate(j)] += (hits - times * p) * x
        weights += RATE * slopes / np.maximum(total_of, 1)[:, None] / 4
    happened = {(i, j): (hits, times) for i, j, hits, times in cells}
    out = {}
    for j in range(GRADES_PER_DOUBLING, GRADES):
        for i in range(GRADES_PER_DOUBLING, j + 1):
            p = 1 / (1 + math.exp(-float(np.clip(weights[_gate(j)] @ odds(i, j), -14, 14))))
            hits, times = happened.get((i, j), (0.0, 0.0))
            out[i, j] = min(max((hits + 2 * p) / (times + 2), 1e-6), 1 - 1e-6)
    return out


def gains(found: DataFrame, phrases: Phrases) -> DataFrame:
    """(_row, gain): what the decisions on phrases add to the log10 probability of a row. `found` holds (_row, own, _p),
    a phrase with its context and the cost of spelling it; `own` occurrences of the row are taken off the counts.

    Contexts that nothing else has seen decide nothing. Favourites are joined with phrases on the context, one row each.
    """
    rows = found.select("_row", "own", "_p.context", "_p.phrase", "_p.cost")
    hit = F.col("phrase") == F.col("favourite")
    met = rows.join(phrases.favourites, "context").select(
        "_row",
        "cost",
        hit.alias("hit"),
        (F.col("n") - F.when(hit, F.col("own")).otherwise(0)).alias("n"),
        (F.col("total") - F.col("own")).alias("total"),
    )
    graded = met.where(F.col("n") > 0).select(
        "_row", "cost", "hit", grade(F.col("n")).alias("n_grade"), grade(F.greatest("n", "total")).alias("total_grade")
    )
    # By arithmetic at most GRADES * GRADES / 2 rows.
    known = graded.join(F.broadcast(phrases.chances), ["n_grade", "total_grade"])
    gain = F.when(F.col("hit"), F.log10("chance") - F.col("cost")).otherwise(F.log10(1 - F.col("chance")))
    return known.select("_row", gain.alias("gain"))
