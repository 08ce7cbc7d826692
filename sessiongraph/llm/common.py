"""Helpers of the text operators: Arrow passes over (id, text), word hashes, stored intermediate tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Functions of this package travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 2_000_000

WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
# All ASCII bytes but letters and digits; bytes of other scripts belong to words.
PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())

_POWERS = 1 << 16
_MULTIPLIER = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    out = values.astype(np.uint64, copy=True)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def separator_table(separators: bytes = WHITE_SPACE) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = True
    return table


def slices(texts: Iterable[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about `limit` bytes, each with the position of its first text."""
    start, held, size = 0, [], 0
    for position, text in enumerate(texts):
        held.append(text)
        size += len(text) + 1
        if size >= limit:
            yield start, held
            start, held, size = position + 1, [], 0
    if held:
        yield start, held


def word_spans(buffer: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words in a byte buffer that ends with a separator."""
    gap = separators[buffer]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(gap) and not gap[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2] - edge[0::2]


def span_hashes(buffer: np.ndarray, separators: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a buffer; the spans are those of `word_spans`."""
    if not _powers:
        _powers.append(np.cumprod(np.full(_POWERS, _MULTIPLIER, dtype=np.uint64)))
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = buffer[~separators[buffer]].astype(np.uint64) + np.uint64(1)
    values *= _powers[0][place & (_POWERS - 1)]
    return mix(np.add.reduceat(values, first))


def word_hashes(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and offsets: text i has `hashes[offsets[i]:offsets[i + 1]]`."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    buffer = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts, lengths = word_spans(buffer, separators)
    offsets = np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)
    return span_hashes(buffer, separators, starts, lengths), offsets


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hashes of all runs of `width` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(_MULTIPLIER) + hashes[k : k + n]
    return mix(out)


def lowered(text: str | None) -> bytes:
    return text.lower().encode() if text else b""


def text_pass(
    df: DataFrame, function: Callable[[list, list], dict], schema: str, id_column: str, text_column: str
) -> DataFrame:
    """One Arrow pass: `function(ids, texts)` of each batch returns the columns of `schema`.

    Only the two named columns are read, so others may have any name.
    """
    chosen = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    target = df.sparkSession.createDataFrame([], schema).schema
    names = target.names
    arrow = _arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                columns = function(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[name], type=arrow.field(name).type) for name in names], schema=arrow
                )

    return chosen.mapInArrow(run, target)


def kept_rows(df: DataFrame, keeps: Callable[[list], np.ndarray], text_column: str = "text") -> DataFrame:
    """The rows of `df` for whose texts `keeps` is true, whatever their ids; one pass, nothing is shuffled."""
    place = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, column=place):
                yield part.filter(pa.array(keeps(part.column(place).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def parts(batch: pa.RecordBatch, column: int = 1, limit: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` text bytes each."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy())
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + limit)))
        yield batch.slice(start, stop - start)
        start = stop
