"""A byte-level language model that mixes hashed-context bit predictors, with phrases of the corpus above the bytes, and
scores of whole texts."""

from __future__ import annotations

import heapq
import math
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongraph.llm import phrases
from sessiongraph.llm.common import SLICE_BYTES, mix, parts, separator_table, span_hashes, word_spans
from sessiongraph.llm.phrases import cut as cut_phrases
from sessiongraph.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Counters of all predictors share one table of 2**SLOT_BITS pairs.
SLOT_BITS = 23
PREDICTORS = 4
ORDERS = (2, 3, 5)
# Groups (languages) with contexts of their own; the rest share the last one.
GROUPS = 16
BLOCK_SLOTS = 1 << 14
# Weight sets of the mixer: chosen by how much the longest contexts have seen (see `gates`).
GATES = 16
APM_BUCKETS = 33
APM_SHARE = 0.5
LEARNING_RATE = 0.2
LONGEST_STEP = 0.02
# The most frequent tokens, by arithmetic at most this many: their counts travel to the tasks, and only they
# teach the predictor of whole prefixes. Counts of all others are joined.
FREQUENT = 1 << 17
PREVIOUS = 4_096
BATCH_TOKENS = 2_000
# Spelled words that a task keeps, at 12 bytes each.
CACHED_WORDS = 1_000_000
RECENT_WORDS = 100_000
COUNTED_TOKENS = 300_000
END, TERMINATOR = 0x0A, 0x20
TOKEN, FIRST, BYTE = 0, 1, 2

_SALTS = mix(np.arange(11, 11 + 64, dtype=np.uint64))
_GROUP_SALTS = mix(np.arange(101, 101 + GROUPS, dtype=np.uint64))
_SHIFT = np.uint64(64 - SLOT_BITS)
_LOG10_E = 1 / math.log(10)


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space of the text with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def _previous(last_two: np.ndarray) -> np.ndarray:
    return (mix(last_two + np.uint64(1)) & np.uint64(PREVIOUS - 1)).astype(np.int64)


@dataclass
class Spoken:
    """The words of several texts: the joined bytes, starts and lengths in them, words per text; and previous context
    and first byte of all tokens, ends included."""

    joined: bytes
    starts: np.ndarray
    lengths: np.ndarray
    sizes: np.ndarray
    previous: np.ndarray
    first: np.ndarray
    is_word: np.ndarray

    def hashes(self) -> np.ndarray:
        raw = np.frombuffer(self.joined, dtype=np.uint8)
        return span_hashes(raw, separator_table(), self.starts, self.lengths)


def spoken_of(texts: list[str | None]) -> Spoken:
    buffers = [t.encode("utf-8", "replace").lower() if t else b"" for t in texts]
    joined = b" ".join(buffers) + b" "
    raw = np.frombuffer(joined, dtype=np.uint8)
    starts, lengths = word_spans(raw, separator_table())
    ends = np.cumsum([len(b) + 1 for b in buffers])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    # Tokens of a text: its words, then the end.
    n_tokens = counts + 1
    total = int(n_tokens.sum())
    end_at = np.cumsum(n_tokens) - 1
    is_word = np.ones(total, dtype=bool)
    is_word[end_at] = False
    first = np.full(total, END, dtype=np.int64)
    first[is_word] = raw[starts]
    final = starts + lengths - 1
    last_two = np.zeros(total, dtype=np.uint64)
    last_two[is_word] = raw[final].astype(np.uint64) | np.where(
        lengths > 1, raw[np.maximum(final - 1, 0)].astype(np.uint64) << np.uint64(8), np.uint64(0)
    )
    before = np.zeros(total, dtype=np.uint64)
    before[1:] = last_two[:-1]
    before[np.concatenate(([0], end_at[:-1] + 1))] = 0
    return Spoken(joined, starts, lengths, counts, _previous(before), first, is_word)


@dataclass
class Events:
    """Byte predictions: context hashes (one row per predictor), the byte, the token it belongs to."""

    contexts: np.ndarray
    symbols: np.ndarray
    owner: np.ndarray


def token_events(tokens: list[bytes], group: np.ndarray, long_context: np.ndarray) -> Events:
    """All bytes of the tokens but the first, and their terminator. Contexts: the last 2, 3 and 5 bytes of the token
    and all of it so far, each within the group. Tokens without `long_context` leave the last one empty."""
    buffer = np.frombuffer(b" ".join(tokens) + b" ", dtype=np.uint8)
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    owner = np.repeat(np.arange(len(tokens)), lengths)
    first = np.cumsum(lengths + 1) - lengths - 1
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    at = first[owner] + place
    wide = buffer.astype(np.uint64) + np.uint64(1)
    running = np.zeros(len(at), dtype=np.uint64)
    contexts = []
    for k in range(1, max(ORDERS) + 1):
        back = np.where(place >= k, wide[np.maximum(at - k, 0)], np.uint64(0))
        running = running + (back << np.uint64(9 * (k - 1)))
        if k in ORDERS:
            contexts.append(running)
    power = np.cumprod(np.full(4_096, 0x9E3779B97F4A7C15, dtype=np.uint64))
    terms = wide[at - 1] * power[place & 4_095]
    prefix = np.cumsum(terms, dtype=np.uint64)
    starts = np.cumsum(lengths) - lengths
    prefix = prefix - (prefix[starts] - terms[starts])[owner]
    contexts.append(np.where(long_context[owner], prefix | np.uint64(1), np.uint64(0)))
    salts = _SALTS[:PREDICTORS, None] + _GROUP_SALTS[group[owner]][None, :]
    return Events(mix(mix(np.stack(contexts)) + salts), buffer[at].astype(np.int64), owner)


def first_events(group: np.ndarray, previous: np.ndarray, symbols: np.ndarray) -> Events:
    """First bytes of tokens, within the group: no context, and several views of the bytes before the token."""
    p = previous.astype(np.uint64)
    views = np.stack([np.zeros_like(p), p & np.uint64(63), p & np.uint64(511), p])
    salts = _SALTS[PREDICTORS : 2 * PREDICTORS, None] + _GROUP_SALTS[group][None, :]
    return Events(mix(views + salts), symbols.astype(np.int64), np.arange(len(symbols)))


def byte_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, codes) of a Huffman code over all 256 bytes: frequent bytes take few binary decisions."""
    heap = [(int(n) * 256 + 1, byte, (byte,)) for byte, n in enumerate(counts)]
    heapq.heapify(heap)
    lengths, codes = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    while len(heap) > 1:
        (low, _, left), (high, tie, right) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in enumerate((left, right)):
            for byte in side:
                codes[byte] |= bit << lengths[byte]
                lengths[byte] += 1
        heapq.heappush(heap, (low + high, tie, left + right))
    return lengths, codes


def bits(events: Events, code: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The binary decisions of every byte: (events that still have one, slots per predictor, bit)."""
    lengths, codes = code[0][events.symbols], code[1][events.symbols]
    for bit in range(int(lengths.max(initial=0))):
        alive = np.flatnonzero(lengths > bit)
        rest = lengths[alive] - bit
        node = ((1 << bit) | (codes[alive] >> rest)).astype(np.uint64)
        # Contexts are well mixed, so one product spreads them with the node.
        slots = events.contexts.take(alive, axis=1)
        slots ^= node * np.uint64(0xD6E8FEB86659FD93)
        slots *= np.uint64(0x9E3779B97F4A7C15)
        slots >>= _SHIFT
        slots = slots.view(np.int64)
        yield alive, slots, (codes[alive] >> (rest - 1)) & 1


def gates(seen: np.ndarray) -> np.ndarray:
    """The weight set: four grades of what the whole-prefix and the three-byte context have seen."""
    return grade_of(seen[3]).astype(np.int64) * 4 + grade_of(seen[1])


def grade_of(seen: np.ndarray) -> np.ndarray:
    return (seen > 0.5).view(np.uint8) + (seen > 8.0) + (seen > 128.0)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -25, 25)))


def apm_cells(x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    bucket = np.clip(np.rint((x + 8) * 2), 0, APM_BUCKETS - 1).astype(np.int64)
    return gate * APM_BUCKETS + bucket


@dataclass
class Mixer:
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, PREDICTORS), 0.35))
    refined: np.ndarray = field(default_factory=lambda: np.zeros((2, GATES * APM_BUCKETS)))

    def inputs(self, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input per predictor, gate, mixed value before squashing)."""
        x = np.log((ones + 0.3) / (zeros + 0.3))
        gate = gates(zeros + ones)
        return x, gate, self.mixed(x, gate)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = np.ascontiguousarray(self.weights.T)
        out = weights[0].take(gate) * x[0]
        for k in range(1, PREDICTORS):
            out += weights[k].take(gate) * x[k]
        return out

    def probability(self, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The chance of a one: the mixed one and the adaptive map's for its neighbourhood, averaged."""
        p = squash(mixed)
        cells = apm_cells(mixed, gate)
        hits, total = self.refined[1].take(cells), self.refined.sum(axis=0).take(cells)
        learned = (hits + p) / (total + 1)
        return np.clip((1 - APM_SHARE) * p + APM_SHARE * learned, 1e-7, 1 - 1e-7)

    def learn(self, zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """One online step on a batch of decisions: descent on coding cost per weight set, counts of the map."""
        x, gate, mixed = self.inputs(zeros, ones)
        p = squash(mixed)
        error = (bit - p) * weight
        size = np.abs(x)
        spread = p * (1 - p) * weight * size.sum(axis=0)
        for k in range(PREDICTORS):
            slope = np.bincount(gate, error * x[k], GATES)
            bend = np.bincount(gate, spread * size[k], GATES)
            self.weights[:, k] += np.clip(LEARNING_RATE * slope / (bend + 1.0), -LONGEST_STEP, LONGEST_STEP)
        np.clip(self.weights, -0.5, 1.5, out=self.weights)
        cells = apm_cells(mixed, gate)
        self.refined[1] += np.bincount(cells, weight * bit, GATES * APM_BUCKETS)
        self.refined[0] += np.bincount(cells, weight * (1 - bit), GATES * APM_BUCKETS)


def prepare(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What scoring reads of each counter: its log odds, and the grade of what it has seen."""
    zeros, ones = table[0].astype(np.float32), table[1].astype(np.float32)
    odds = np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3))).astype(np.float16)
    return odds, grade_of(zeros + ones)


def event_costs(events: Events, code: tuple[np.ndarray, np.ndarray], table: np.ndarray, mixer: Mixer) -> np.ndarray:
    """log10 of the probability of every byte."""
    return prepared_costs(events, code, prepare(table), mixer)


def prepared_costs(
    events: Events, code: tuple[np.ndarray, np.ndarray], prepared: tuple[np.ndarray, np.ndarray], mixer: Mixer
) -> np.ndarray:
    odds, grades = prepared
    out = np.zeros(len(events.symbols))
    for alive, slots, bit in bits(events, code):
        gate = grades.take(slots[3]).astype(np.int64) * 4 + grades.take(slots[1])
        p = mixer.probability(mixer.mixed(odds.take(slots), gate), gate)
        out[alive] += np.log(np.where(bit == 1, p, 1 - p)) * _LOG10_E
    return out


@dataclass
class Model:
    """What scoring needs: a fixed-size counter table, the mixer, and counts of the frequent tokens by group. Phrases
    stay in their table, which grows with the corpus."""

    table: np.ndarray
    mixer: Mixer
    code: tuple[np.ndarray, np.ndarray]
    frequent: dict[bytes, int]
    group_counts: np.ndarray
    group_texts: np.ndarray
    long_from: int
    train_tokens: int
    distinct: int
    phrases: phrases.Phrases | None = None

    def values(self) -> dict:
        """Plain values for the tasks, which need no copy of this package."""
        kept = {k: v for k, v in vars(self).items() if k not in ("phrases", "table")}
        return kept | {"mixer": vars(self.mixer), "table": prepare(self.table)}


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts, and counts of (previous context, first byte), by group, and of the bytes of all tokens; added up per
    task as far as memory allows."""
    tokens: dict[int, Counter] = {}
    pairs: dict[int, np.ndarray] = {}
    seen = np.zeros(256, dtype=np.int64)

    def rows(keys: list[bytes], counts: list[int], kind: int, group: int) -> pa.RecordBatch:
        size = len(keys)
        columns = [pa.array([kind] * size, pa.int32()), pa.array([group] * size, pa.int32())]
        columns += [pa.array(keys, pa.binary()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "group", "token", "n"])

    def flush() -> Iterator[pa.RecordBatch]:
        for group, held in tokens.items():
            yield rows(list(held), list(held.values()), TOKEN, group)
        tokens.clear()

    for batch in batches:
        for part in parts(batch, column=0, limit=SLICE_BYTES):
            texts, groups = part.column(0).to_pylist(), part.column(1).to_numpy()
            for group in np.unique(groups).tolist():
                spoken = spoken_of([texts[i] for i in np.flatnonzero(groups == group)])
                held = tokens.setdefault(group, Counter())
                held.update(spoken.joined.split())
                # The end is a token of its own; no word holds a line feed.
                held[bytes([END])] += len(spoken.sizes)
                raw = np.bincount(np.frombuffer(spoken.joined, dtype=np.uint8), minlength=256)
                raw[separator_table()] = 0
                raw[END] = len(spoken.sizes)
                seen += raw
                cells = np.bincount(spoken.previous * 256 + spoken.first, minlength=PREVIOUS * 256)
                pairs[group] = pairs[group] + cells if group in pairs else cells
            if sum(map(len, tokens.values())) > COUNTED_TOKENS:
                yield from flush()
    yield from flush()
    for group, cells in pairs.items():
        full = np.flatnonzero(cells)
        yield rows([int(c).to_bytes(3, "big") for c in full], cells[full].tolist(), FIRST, group)
    full = np.flatnonzero(seen)
    yield rows([bytes([b]) for b in full.tolist()], seen[full].tolist(), BYTE, 0)


def _event_batches(batch: pa.RecordBatch, long_from: int) -> Iterator[tuple[Events, np.ndarray]]:
    """Events of counted tokens with their counts."""
    kinds, groups = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    keys, counts = batch.column(2).to_pylist(), batch.column(3).to_numpy()
    words = np.array([i for i in np.flatnonzero(kinds == TOKEN).tolist() if keys[i][0] != END], dtype=np.int64)
    for start in range(0, len(words), BATCH_TOKENS):
        chosen = words[start : start + BATCH_TOKENS]
        weight = counts[chosen]
        events = token_events([keys[i] for i in chosen.tolist()], groups[chosen], weight >= long_from)
        yield events, weight[events.owner]
    first = np.flatnonzero(kinds == FIRST)
    if len(first):
        cells = np.array([int.from_bytes(keys[i], "big") for i in first])
        yield first_events(groups[first], cells // 256, cells % 256), counts[first]


def counter(code: tuple[np.ndarray, np.ndarray], long_from: int):
    """Adds all decisions of a task to a counter table; gives its blocks that are not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Doubles, so that a count of one is not lost beside a frequent token's.
        table = np.zeros((2, 1 << SLOT_BITS))
        flat = table.reshape(-1)
        for batch in batches:
            for events, weight in _event_batches(batch, long_from):
                weight = weight.astype(np.float64)
                for alive, slots, bit in bits(events, code):
                    slots += bit << SLOT_BITS
                    for row in slots:
                        np.add.at(flat, row, weight[alive])
        cells = table.reshape(2, -1, BLOCK_SLOTS)
        for block in range(cells.shape[1]):
            if cells[:, block].any():
                values = cells[:, block].astype(np.float32).tobytes()
                columns = [pa.array([block], pa.int32()), pa.array([values], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "cells"])

    return run


def add_blocks(table: pa.Table) -> pa.Table:
    """The sum of one block over all tasks, halved where needed to fit 16 bits with the ratio kept."""
    total = np.zeros((2, BLOCK_SLOTS))
    for cells in table["cells"]:
        total += np.frombuffer(cells.as_py(), dtype=np.float32).reshape(2, BLOCK_SLOTS)
    scale = np.maximum(total.max(axis=0) / 65_000, 1)
    small = np.where(total > 0, np.maximum(np.rint(total / scale), 1), 0).astype(np.uint16)
    return pa.table({"block": table["block"].slice(0, 1), "cells": pa.array([small.tobytes()], pa.binary())})


def packed(table: np.ndarray) -> np.ndarray:
    """Both counts of each counter in one number, so that they are fetched at once."""
    return table[0].astype(np.uint32) | table[1].astype(np.uint32) << np.uint32(16)


def learner(shared, code: tuple[np.ndarray, np.ndarray], long_from: int):
    """Online learning over a task's tokens; every decision is predicted as if this occurrence were not counted. The table
    is the `packed` one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        mixer = Mixer()
        total = 0.0
        for batch in batches:
            for events, weight in _event_batches(batch, long_from):
                for alive, slots, bit in bits(events, code):
                    cells = table.take(slots)
                    zeros, ones = (cells & np.uint32(0xFFFF)).astype(np.float32), (cells >> np.uint32(16)).astype(np.float32)
                    zeros -= (bit == 0) & (zeros >= 1)
                    ones -= (bit == 1) & (ones >= 1)
                    mixer.learn(zeros, ones, bit, weight[alive].astype(np.float32))
                total += float(weight.sum())
        values = np.concatenate((mixer.weights.ravel() * total, mixer.refined.ravel(), [total]))
        columns = [pa.array(np.arange(len(values)), pa.int32()), pa.array(values)]
        yield pa.RecordBatch.from_arrays(columns, names=["position", "value"])

    return run


def train(texts: DataFrame, text_column: str = "text", group_column: str | None = "lang") -> tuple[Model, DataFrame]:
    """The model of all whole `texts`, and the table of its token counts (token, n).

    The most frequent values of `group_column`, if given, have contexts of their own; other values and null share a
    group. The column is read in training only: scoring tells the group from the text.
    """
    spark = texts.sparkSession
    names: list = []
    if group_column:
        named = texts.where(F.col(group_column).isNotNull()).groupBy(group_column).count()
        names = [r[0] for r in named.orderBy(F.desc("count"), group_column).limit(GROUPS - 1).collect()]
    numbers = F.array(*[F.lit(name) for name in names]).cast("array<string>")
    place = F.array_position(numbers, F.col(group_column).cast("string")) if names else F.lit(0)
    group = F.coalesce(place, F.lit(0)).cast("int").alias("group")
    schema = "kind int, group int, token binary, n long"
    counted = texts.select(F.col(text_column).alias("text"), group).mapInArrow(count_tokens, schema)
    # Dealt by token once: its counts by group (at most GROUPS) and their sum come from the same shuffle.
    counted = counted.repartition("kind", "token").groupBy("kind", "group", "token").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("kind", "token").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("group", "n")).alias("groups")
    )
    counted = materialize(counted, "token_counts")
    tokens = counted.where(F.col("kind") == TOKEN).select("token", "n")
    # Tokens by quarter powers of two of their count: a few hundred rows.
    grade = F.floor(F.log2("n") * 4).cast("int").alias("grade")
    grades = sorted(tokens.groupBy(grade).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect(), reverse=True)
    train_tokens, distinct = sum(row["n"] for row in grades), sum(row["v"] for row in grades)
    frequent_from, held = 1 << 30, 0
    for row in grades:
        held += row["v"]
        if held > FREQUENT:
            break
        frequent_from = row["grade"]
    often, end = grade >= frequent_from, F.col("token") == F.lit(bytearray([END]))
    chosen = counted.where((F.col("kind") == TOKEN) & (often | end)).select("token", "n", "groups", often.alias("often"))
    frequent: dict[bytes, int] = {}
    shares: list[tuple[int, int, int]] = []
    group_texts = np.zeros(GROUPS)
    for row in chosen.toLocalIterator():
        token = bytes(row["token"])
        if token == bytes([END]):
            for group_number, n in row["groups"]:
                group_texts[group_number] = n
        if row["often"]:
            shares += [(group_number, len(frequent), n) for group_number, n in row["groups"]]
            frequent[token] = row["n"]
    group_counts = np.zeros((GROUPS, len(frequent)), dtype=np.float32)
    for group_number, place_of_token, n in shares:
        group_counts[group_number, place_of_token] = n
    long_from = max(2, min(frequent.values(), default=2))

    bytes_seen = np.zeros(256)
    for row in counted.where(F.col("kind") == BYTE).select("token", "n").collect():
        bytes_seen[row["token"][0]] = row["n"]
    bytes_seen[TERMINATOR] = train_tokens
    code = byte_code(bytes_seen)

    by_group = counted.where(F.col("kind") != BYTE).select("kind", "token", F.inline("groups"))
    by_group = by_group.select("kind", "group", "token", "n")
    blocks = by_group.mapInArrow(counter(code, long_from), "block int, cells binary")
    blocks = blocks.groupBy("block").applyInArrow(add_blocks, "block int, cells binary")
    table = np.zeros((2, 1 << SLOT_BITS), dtype=np.uint16)
    for row in blocks.toLocalIterator():
        cells = np.frombuffer(bytes(row["cells"]), dtype=np.uint16).reshape(2, BLOCK_SLOTS)
        table[:, row["block"] * BLOCK_SLOTS : (row["block"] + 1) * BLOCK_SLOTS] = cells

    shared = spark.sparkContext.broadcast(packed(table))
    learned = by_group.mapInArrow(learner(shared, code, long_from), "position int, value double")
    sums = {r["position"]: r["value"] for r in learned.groupBy("position").agg(F.sum("value").alias("value")).collect()}
    mixer = Mixer()
    n_weights = GATES * PREDICTORS
    if sums and sums[len(sums) - 1] > 0:
        values = np.array([sums[i] for i in range(len(sums))])
        mixer.weights = values[:n_weights].reshape(GATES, PREDICTORS) / values[-1]
        mixer.refined = values[n_weights:-1].reshape(2, -1)
    shared.destroy()
    learned_phrases = phrases.learn(texts.select(F.col(text_column).alias("text")))
    model = Model(
        table, mixer, code, frequent, group_counts, group_texts, long_from, train_tokens, distinct, learned_phrases
    )
    return model, tokens


class SortedValues:
    """Values by 64-bit keys in ascending order."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None) -> None:
        self.keys = np.empty(0, dtype=np.uint64) if keys is None else keys
        self.values = np.empty(0, dtype=np.float32) if values is None else values

    def find(self, keys: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Which keys are there; their values go to `out`."""
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[place] == keys
            out[known] = self.values[place[known]]
        return known

    def joined(self, keys: np.ndarray, values: np.ndarray) -> SortedValues:
        """With more keys, none of which is there yet."""
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        return SortedValues(
            np.insert(self.keys, place, keys[order]), np.insert(self.values, place, values[order].astype(np.float32))
        )


class TokenCosts:
    """Per group and token: log10 probability of what follows its first byte, and its base score if it is frequent."""

    def __init__(self, model: Model) -> None:
        """The table of `model` is the prepared one."""
        self.model = model
        self.order = {token: i for i, token in enumerate(model.frequent)}
        self.base_of = np.array([self.base(n) for n in model.frequent.values()] + [np.nan])
        total = model.group_counts.sum(axis=1, keepdims=True)
        self.group_of = np.zeros((GROUPS, len(self.order) + 1), dtype=np.float32)
        for g in np.flatnonzero(model.group_texts).tolist():
            share = (model.group_counts[g] + np.float32(0.1)) / (total[g] + 0.1 * len(self.order) + 1)
            self.group_of[g, :-1] = np.log10(share)
        texts = max(model.group_texts.sum(), 1)
        with np.errstate(divide="ignore"):
            self.prior = np.log10(model.group_texts / texts)
        if not model.group_texts.any():
            self.prior[0] = 0.0
        # Words spelled so far.
        self.many, self.recent = SortedValues(), SortedValues()
        self.firsts: dict[int, np.ndarray] = {}

    def first(self, group: int, cells: np.ndarray) -> np.ndarray:
        """log10 probability of first bytes after their contexts; a cell is context * 256 + byte."""
        if group not in self.firsts:
            self.firsts[group] = np.full(PREVIOUS * 256, np.nan)
        known = self.firsts[group]
        fresh = np.unique(cells[np.isnan(known[cells])])
        if len(fresh):
            events = first_events(np.full(len(fresh), group), fresh // 256, fresh % 256)
            known[fresh] = prepared_costs(events, self.model.code, self.model.table, self.model.mixer)
        return known[cells]

    def base(self, count: int) -> float:
        return math.log10((count + 1) / (self.model.train_tokens + self.model.distinct + 1))

    def spelled(self, group: int, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
        """log10 probability of all but the first byte of `words`, whose hashes are given; the words differ."""
        keys = mix(hashes + _GROUP_SALTS[group])
        out = np.zeros(len(keys))
        known = self.many.find(keys, out) | self.recent.find(keys, out)
        missing = np.flatnonzero(~known)
        for start in range(0, len(missing), BATCH_TOKENS):
            at = missing[start : start + BATCH_TOKENS]
            chosen = [words[i] for i in at.tolist()]
            is_long = np.array([w in self.order for w in chosen], dtype=bool)
            events = token_events(chosen, np.full(len(chosen), group), is_long)
            costs = prepared_costs(events, self.model.code, self.model.table, self.model.mixer)
            out[at] = np.bincount(events.owner, costs, len(chosen))
        self.recent = self.recent.joined(keys[missing], out[missing])
        if len(self.recent.keys) > RECENT_WORDS:
            if len(self.many.keys) > CACHED_WORDS:
                self.many = SortedValues()
            self.many, self.recent = self.many.joined(self.recent.keys, self.recent.values), SortedValues()
        return out


_costs: dict[str, TokenCosts] = {}


def scorer(shared, key: str):
    """Scores of all texts; base scores cover frequent tokens only, the others are listed for a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _costs:
            _costs.clear()
            values = shared.value
            mixer = Mixer.__new__(Mixer)
            vars(mixer).update(values["mixer"])
            _costs[key] = TokenCosts(Model(**(values | {"mixer": mixer})))
        costs = _costs[key]
        for batch in batches:
            for part in parts(batch, limit=SLICE_BYTES):
                yield score_part(part, costs)

    return run


RARE_TYPE = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))


PHRASE_TYPE = pa.list_(pa.struct([("context", pa.int64()), ("phrase", pa.int64()), ("cost", pa.float32())]))


def score_part(part: pa.RecordBatch, costs: TokenCosts) -> pa.RecordBatch:
    texts = part.column(1).to_pylist()
    n = len(texts)
    spoken = spoken_of(texts)
    sizes = spoken.sizes
    hashes = spoken.hashes()
    distinct, index, word_of = np.unique(hashes, return_index=True, return_inverse=True)
    spans = zip(spoken.starts[index].tolist(), spoken.lengths[index].tolist(), strict=True)
    words = [spoken.joined[start : start + length] for start, length in spans]
    owner = np.repeat(np.arange(n), sizes)
    # All tokens that are not frequent share the place after the last.
    place_of = np.fromiter(map(costs.order.get, words, repeat(len(costs.order))), dtype=np.int64, count=len(words))
    place = place_of[word_of]
    # The group under which the frequent tokens of the text are likeliest; naming it costs its prior.
    fit = np.stack([np.bincount(owner, row[place], n) if p > -np.inf else np.zeros(n) for p, row in zip(costs.prior, costs.group_of, strict=True)])
    fit += costs.prior[:, None]
    group = fit.argmax(axis=0)
    n_tokens = sizes + 1
    cells = spoken.previous * 256 + spoken.first
    token_owner = np.repeat(np.arange(n), n_tokens)
    token_cost = np.zeros(len(token_owner))
    word_cost = np.zeros(len(owner))
    word_group, token_group = group[owner], group[token_owner]
    for g in np.unique(group).tolist():
        mine = np.flatnonzero(word_group == g)
        used = np.zeros(len(words), dtype=bool)
        used[word_of[mine]] = True
        chosen = np.flatnonzero(used)
        named = [words[i] for i in chosen.tolist()]
        value = np.zeros(len(words))
        value[chosen] = costs.spelled(g, distinct[chosen], named)
        word_cost[mine] = value[word_of[mine]]
        mine = np.flatnonzero(token_group == g)
        token_cost[mine] = costs.first(g, cells[mine])
    token_cost[spoken.is_word] += word_cost
    score = costs.prior[group] + np.bincount(token_owner, token_cost, n)
    base = costs.base_of[place]
    listed = np.isnan(base)
    base_score = np.bincount(owner, np.where(listed, 0, base), n).astype(np.float64)
    known = np.bincount(owner, ~listed, n).astype(np.int64)
    rare = owner[listed] * (len(words) + 1) + word_of[listed]
    n_bytes = np.bincount(owner, spoken.lengths, n) + n_tokens
    end = costs.model.frequent.get(bytes([END]))
    if end is None:
        rare = np.concatenate((rare, np.arange(n) * (len(words) + 1) + len(words)))
    else:
        base_score += costs.base(end)
        known += 1
    rare, times = np.unique(rare, return_counts=True)
    tokens = pa.array([words[i] if i < len(words) else bytes([END]) for i in (rare % (len(words) + 1)).tolist()], pa.binary())
    listed_tokens = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(rare, np.arange(n + 1) * (len(words) + 1)), pa.int32()),
        pa.StructArray.from_arrays([tokens, pa.array(times, pa.int64())], fields=list(RARE_TYPE.value_type)),
    )
    found = cut_phrases(hashes, sizes)
    # A phrase costs its tokens, and the end if it is the last one.
    from_token = found.start + found.owner
    phrase_cost = np.add.reduceat(token_cost, from_token) if len(from_token) else np.empty(0)
    keyed = found.has_context
    offsets = np.concatenate(([0], np.cumsum(np.bincount(found.owner[keyed], minlength=n))))
    entries = pa.StructArray.from_arrays(
        [
            pa.array(found.context[keyed].view(np.int64)),
            pa.array(found.phrase[keyed].view(np.int64)),
            pa.array(phrase_cost[keyed].astype(np.float32)),
        ],
        fields=list(PHRASE_TYPE.value_type),
    )
    return pa.RecordBatch.from_arrays(
        [
            part.column(0),
            part.column(2),
            pa.array(n_tokens, pa.int64()),
            pa.array(known, pa.int64()),
            pa.array(base_score),
            pa.array(score),
            pa.array(n_bytes.astype(np.int64), pa.int64()),
            listed_tokens,
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries),
        ],
        names=["doc_id", "own", "n_tokens", "known", "base", "score", "n_bytes", "rare", "phrases"],
    )


def held_out(id_column: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(
    df: DataFrame,
    model: Model,
    tokens: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    trained: Column | None = None,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every whole text.

    Tokens are the words between ASCII white space (A-Z in lower case) and one end per text. `base_score` is the log10
    probability by add-one token counts, `score` that of the mixed model: every byte is a few binary decisions (a Huffman
    code), each predicted by four counters under hashed contexts, combined by weights chosen by a gate and refined by an
    adaptive map. Contexts are those of one group, the one under which the text's frequent tokens are likeliest; naming
    it is part of the cost, so `score` is a probability of the text.

    Above the bytes are phrases (see `phrases`): whether the next phrase is the one that followed the last four words
    most often in the corpus is one more binary decision, and only phrases that are not are spelled. `trained` says which
    rows the model has learned from: what such a row itself added to a phrase's counts is taken off again, so a text is
    no evidence of itself; without it no row counts as learned from.

    `bits_per_byte` is -score in bits for each byte of the tokens with one separator each.

    Null text counts as empty: one token, the end. Repeated rows are kept, null ids too; other columns are not read.
    Counts of the most frequent tokens travel with the model, all other tokens are joined with the whole token table,
    one row per document and token, so no hot token is shuffled.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model.values())
    schema = (
        "doc_id long, own int, n_tokens long, known long, base double, score double, n_bytes long, "
        "rare array<struct<token:binary,n:long>>, phrases array<struct<context:long,phrase:long,cost:float>>"
    )
    own = F.lit(0) if trained is None else F.coalesce(trained.cast("int"), F.lit(0))
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), own.alias("own"))
    scored = rows.mapInArrow(scorer(shared, uuid.uuid4().hex), schema).withColumn("_row", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    rare = scored.select("_row", F.explode("rare").alias("_t")).select("_row", "_t.token", F.col("_t.n").alias("_times"))
    size = float(model.train_tokens + model.distinct + 1)
    counted = rare.join(tokens, "token", "left").select(
        "_row",
        (F.col("_times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(size))).alias("_base"),
        F.when(F.col("n") > 0, F.col("_times")).otherwise(0).cast("long").alias("_known"),
        F.lit(0.0).alias("_gain"),
    )
    gained = phrases.gains(scored.select("_row", "own", F.explode("phrases").alias("_p")), model.phrases).select(
        "_row", F.lit(0.0).alias("_base"), F.lit(0).cast("long").alias("_known"), F.col("gain").alias("_gain")
    )
    sums = counted.unionByName(gained).groupBy("_row").agg(
        F.sum("_base").alias("_base"), F.sum("_known").alias("_known"), F.sum("_gain").alias("_gain")
    )
    total = F.col("score") + F.coalesce("_gain", F.lit(0.0))
    return scored.drop("phrases", "rare").join(sums, "_row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        (-total * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
