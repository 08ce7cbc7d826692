"""Alignment of two tokenizers' tokens on the bytes of a text, and corpus-wide counts of linked token pairs."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessiongraph.llm.common import parts
from sessiongraph.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
# Piece types of the model file.
NORMAL, BYTE = 1, 6
# Text bytes worked on at once, bytes of the units that a worker keeps, and of units encoded together.
SLICE = 4_000_000
CACHE_BYTES = 100_000_000
RUN_BYTES = 50_000
# Links that are counted before they are shuffled, and the most pairs looked up without a join.
COUNTED_LINKS = 4_000_000
COMMON_PAIRS = 1 << 20

# Bytes that surely are no white space in any alphabet: printable ASCII, and first bytes of characters that come
# in blocks without white space (U+0085, U+00A0, U+1680, U+2000 to U+3000 lie in the blocks of C2, E1, E2 and E3).
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False


def solid_before(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is surely no white space."""
    last = buffer[at - 1]
    out = (last < 0x80) & _SOLID[last]
    for back in (2, 3, 4):
        inside = (last >= 0x80) & (last < 0xC0)
        last = np.where(inside, buffer[np.maximum(at - back, 0)], 0)
        out |= (last >= 0xC0) & _SOLID[last]
    return out


def cuts(buffer: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Places where neither tokenizer's tokens can reach across: before a space between two solid characters, and
    around a line feed between two. The places in `starts` are taken as well."""
    spots = np.flatnonzero((buffer == 0x20) | (buffer == 0x0A))
    spots = spots[(spots > 0) & (spots < len(buffer) - 1)]
    spots = spots[_SOLID[buffer[spots + 1]] & solid_before(buffer, spots)]
    marked = np.zeros(len(buffer), dtype=bool)
    marked[spots] = True
    marked[spots[buffer[spots] == 0x0A] + 1] = True
    if starts is not None:
        marked[starts] = True
    return np.flatnonzero(marked)


@dataclass(frozen=True)
class Models:
    """Both tokenizers as their files' content, with the bytes of every token."""

    byte_json: str
    piece_model: bytes
    byte_tokens: tuple[bytes, ...]
    piece_tokens: tuple[bytes, ...]
    by_unit: bool

    def digest(self) -> str:
        return hashlib.sha256(self.byte_json.encode() + self.piece_model).hexdigest()


def read_models(byte_path: str, piece_path: str) -> Models:
    """The models of a byte-level BPE file and of a merge-type piece file that leave texts as they are."""
    from sentencepiece import sentencepiece_model_pb2

    with open(byte_path, encoding="utf-8") as source:
        text = source.read()
    content = json.loads(text)
    level = content["pre_tokenizer"] or {}
    if level.get("type") != "ByteLevel" or level.get("add_prefix_space") or content.get("normalizer"):
        raise ValueError("only byte-level vocabularies without a normalizer or a prefix space")
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    vocabulary = content["model"]["vocab"]
    byte_tokens = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in content["added_tokens"])]))
    for token, number in vocabulary.items():
        byte_tokens[number] = bytes(byte_of[c] for c in token if c in byte_of)

    with open(piece_path, "rb") as source:
        raw = source.read()
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(raw)
    rules = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
        raise ValueError("only merge-type piece models that leave the text as it is")
    if not rules.add_dummy_prefix:
        raise ValueError("only piece models that put a space before the text")
    pieces = [(p.piece, p.type) for p in model.pieces]
    piece_tokens = [
        bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, kind in pieces
    ]
    # Units are cut before a space mark and around a line feed: no piece may reach across.
    normal = [p for p, kind in pieces if kind not in (BYTE, 2, 3)]
    by_unit = level.get("use_regex", True) and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal)
    return Models(text, raw, tuple(byte_tokens), tuple(piece_tokens), by_unit)


def groups_of(
    a_ends: np.ndarray, b_ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, first B token of each A token's links, their number).

    Both are the ascending ends of tokens that cover the same bytes without gaps. Every token points to the token
    farthest right that overlaps it, itself if it ends where its own does. Following the pointers twice as far in
    each round, all tokens of a connected group reach the token that ends the group; it labels them.
    """
    n_a, n_b = len(a_ends), len(b_ends)
    a_starts, b_starts = np.concatenate(([0], a_ends[:-1])), np.concatenate(([0], b_ends[:-1]))
    first = np.searchsorted(b_ends, a_starts, "right")
    stop = np.searchsorted(b_starts, a_ends, "left")
    last_a = np.searchsorted(a_starts, b_ends, "left") - 1
    # Nodes: A tokens, then B tokens. An A token's last B token ends with it or after it.
    to_a = np.where(a_ends[last_a] > b_ends, last_a, n_a + np.arange(n_b))
    to = np.concatenate((n_a + stop - 1, to_a))
    while not np.array_equal(further := to[to], to):
        to = further
    is_last = np.zeros(n_b, dtype=np.int64)
    is_last[to - n_a] = 1
    label = (np.cumsum(is_last) - 1)[to - n_a]
    return label[:n_a], label[n_a:], first, stop - first


class Aligner:
    """Aligned units by slot: `numbers` (A tokens, B tokens, groups, links, whether the bytes agree), group texts, link
    keys. Units met before keep their slot until all slots together take too many bytes."""

    def __init__(self, models: Models) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.models = models
        self.byte_level = Tokenizer.from_str(models.byte_json)
        self.byte_level.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=models.piece_model)
        self.a_sizes = np.array([len(t) for t in models.byte_tokens])
        self.b_sizes = np.array([len(t) for t in models.piece_tokens])
        self.a_bytes = pa.array(models.byte_tokens, type=pa.large_binary())
        self.b_bytes = pa.array(models.piece_tokens, type=pa.large_binary())
        self.n_pieces = len(models.piece_tokens)
        sides = ((len(self.a_sizes), ",|"), (self.n_pieces, ",;"))
        names = [f"{i}{mark}".encode() for n, marks in sides for mark in marks for i in range(n)]
        self.names = pa.array(names, type=pa.large_binary())
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.numbers = np.empty((0, 5), dtype=np.int64)
        self.texts: list[bytes] = []
        self.keys: list[bytes] = []
        self.held_bytes = 0

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, A tokens of each unit, B ids, B tokens of each unit).

        Units of solid characters behind one space keep their ends among others of the kind, so they are encoded in
        runs; a run in which a unit's end is no token's end in either vocabulary is encoded unit by unit.
        """
        ids: tuple[list, list] = ([], [])
        counts: tuple[list, list] = ([], [])
        places: list[np.ndarray] = []
        buffer = np.frombuffer(b"".join(units), dtype=np.uint8)
        sizes = np.array([len(u) for u in units])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        second = np.minimum(starts + 1, len(buffer) - 1)
        plain = (buffer[starts] == 0x20) & (sizes > 1) & _SOLID[buffer[second]] & solid_before(buffer, ends)
        plain &= sizes <= RUN_BYTES
        chosen = np.flatnonzero(plain)
        single = [np.flatnonzero(~plain)]
        run_of = (np.cumsum(sizes[chosen]) - 1) // RUN_BYTES
        for rows in np.split(chosen, np.flatnonzero(np.diff(run_of)) + 1) if len(chosen) else []:
            text = b"".join([units[row] for row in rows.tolist()]).decode()
            stops = np.cumsum(sizes[rows])
            run_ids = (
                np.array(self.byte_level.encode(text, add_special_tokens=False).ids),
                np.array(self.pieces.encode(text[1:])),
            )
            at = []
            for side, table in zip(run_ids, (self.a_sizes, self.b_sizes), strict=True):
                reached = np.cumsum(table[side])
                found = np.searchsorted(reached, stops)
                if found[-1] < len(reached) and (reached[found] == stops).all() and found[-1] == len(reached) - 1:
                    at.append(np.diff(found + 1, prepend=0))
            if len(at) < 2:
                single.append(rows)
                continue
            places.append(rows)
            for side in (0, 1):
                ids[side].append(run_ids[side])
                counts[side].append(at[side])
        rows = np.concatenate(single)
        texts = [units[row].decode() for row in rows.tolist()]
        # A unit's own space stands for the space that the model puts first; others follow a line feed, whose two
        # tokens are taken off again.
        spaced = [t[0] == " " for t in texts]
        a = [e.ids for e in self.byte_level.encode_batch(texts, add_special_tokens=False)]
        b = self.pieces.encode([t[1:] if s else "\n" + t for t, s in zip(texts, spaced, strict=True)], num_threads=1)
        b = [found if s else found[2:] for found, s in zip(b, spaced, strict=True)]
        places.append(rows)
        for side, lists in enumerate((a, b)):
            counts[side].append(np.array([len(x) for x in lists], dtype=np.int64))
            ids[side].append(np.array([i for x in lists for i in x], dtype=np.int64))
        order = np.argsort(np.concatenate(places), kind="stable")
        out = []
        for side in (0, 1):
            n, flat = np.concatenate(counts[side]), np.concatenate(ids[side])
            first = (np.cumsum(n) - n)[order]
            n = n[order]
            out += [flat[spread(first, n)], n]
        return tuple(out)

    def align(self, units: list[bytes]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """The numbers, group texts and link keys of units; all zero or empty where the bytes do not agree."""
        a_ids, a_counts, b_ids, b_counts = self.encode(units)
        n_units = len(units)
        sizes = np.array([len(u) for u in units])
        a_unit, b_unit = np.repeat(np.arange(n_units), a_counts), np.repeat(np.arange(n_units), b_counts)
        fits = np.bincount(a_unit, self.a_sizes[a_ids], n_units) == sizes
        fits &= np.bincount(b_unit, self.b_sizes[b_ids], n_units) == sizes
        # Of units that fit by size, the bytes must agree as well.
        places = np.cumsum(np.where(fits, sizes, 0))
        whole = np.frombuffer(b"".join(u for u, f in zip(units, fits.tolist(), strict=True) if f), dtype=np.uint8)
        compared = ((a_ids[fits[a_unit]], self.a_bytes), (b_ids[fits[b_unit]], self.b_bytes))
        for ids, table in compared:
            fits[np.searchsorted(places, np.flatnonzero(whole != joined(table, ids)), "right")] = False
        numbers = np.zeros((n_units, 5), dtype=np.int64)
        numbers[:, 4] = fits
        if not fits.any():
            return numbers, [b""] * n_units, [b""] * n_units
        a_kept, b_kept = fits[a_unit], fits[b_unit]
        a_ids, b_ids, a_unit, b_unit = a_ids[a_kept], b_ids[b_kept], a_unit[a_kept], b_unit[b_kept]

        a_group, b_group, first, n_links = groups_of(np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids]))
        ends_a, ends_b = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
        order = np.argsort(np.concatenate((a_group * 2, b_group * 2 + 1)), kind="stable")
        n_a_names = len(self.a_sizes)
        marked = np.concatenate((a_ids + n_a_names * ends_a, 2 * n_a_names + b_ids + self.n_pieces * ends_b))
        taken = self.names.take(pa.array(marked[order]))
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(order) + 1]
        text = taken.buffers()[2].to_pybytes()
        numbers[:, 0] = np.bincount(a_unit, minlength=n_units)
        numbers[:, 1] = np.bincount(b_unit, minlength=n_units)
        numbers[:, 2] = np.bincount(a_unit[ends_a], minlength=n_units)
        numbers[:, 3] = np.bincount(a_unit, n_links, n_units)
        stops = offsets[np.cumsum(numbers[:, 0] + numbers[:, 1])].tolist()
        links = b_ids[spread(first, n_links)]
        keys = (np.repeat(a_ids, n_links) * self.n_pieces + links).tobytes()
        key_stops = (8 * np.cumsum(numbers[:, 3])).tolist()
        return (
            numbers,
            [text[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)],
            [keys[a:b] for a, b in zip([0, *key_stops[:-1]], key_stops, strict=True)],
        )

    def load(self, units: list[bytes]) -> np.ndarray:
        """The slot of every unit."""
        if self.held_bytes > CACHE_BYTES:
            self.clear()
        slots = np.fromiter(map(self.slots.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            fresh = [units[place] for place in missing.tolist()]
            numbers, texts, keys = self.align(fresh)
            slots[missing] = np.arange(len(self.texts), len(self.texts) + len(fresh))
            self.slots.update(zip(fresh, slots[missing].tolist(), strict=True))
            self.numbers = np.concatenate((self.numbers, numbers))
            self.texts += texts
            self.keys += keys
            self.held_bytes += sum(map(len, fresh)) + sum(map(len, texts)) + sum(map(len, keys)) + 300 * len(fresh)
        return slots


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers `first[i]` to `first[i] + n[i] - 1` for each i, one run after another."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def joined(table: pa.Array, ids: np.ndarray) -> np.ndarray:
    """The bytes of the given rows of a large binary array, one after another."""
    taken = table.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)
    data = taken.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[len(ids)]] if len(ids) else np.empty(0, dtype=np.uint8)


def pieces_of(text: bytes, by_unit: bool, limit: int = SLICE) -> Iterator[bytes]:
    """A long text in pieces of about `limit` bytes, cut where units end."""
    start = 0
    while len(text) - start > limit and by_unit:
        size = limit
        while True:
            window = np.frombuffer(text[start : start + size + 1], dtype=np.uint8)
            found = cuts(window)
            if len(found) or start + size >= len(text):
                break
            size *= 2
        if not len(found):
            break
        yield text[start : start + int(found[-1])]
        start += int(found[-1])
    yield text[start:]


class Tally:
    """What has been found of each text of a batch."""

    def __init__(self, n: int) -> None:
        self.sums = np.zeros((n, 4), dtype=np.int64)
        self.fits = np.zeros(n, dtype=bool)
        self.hashes = [hashlib.sha256() for _ in range(n)]
        self.begun = [False] * n
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def add_slice(tally: Tally, aligner: Aligner, held: list[tuple[int, bytes]]) -> None:
    """Align the given pieces of texts, of which each text has one at most."""
    buffer = np.frombuffer(b"".join(piece for _, piece in held), dtype=np.uint8)
    sizes = np.array([len(piece) for _, piece in held])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    places = cuts(buffer, starts) if aligner.models.by_unit else starts
    places = np.append(places, len(buffer)).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(buffer)]
    ).dictionary_encode()
    code = units.indices.to_numpy()
    slots = aligner.load(units.dictionary.to_pylist())
    numbers = aligner.numbers[slots]
    texts = [aligner.texts[slot] for slot in slots.tolist()]
    keys = [aligner.keys[slot] for slot in slots.tolist()]
    owner = np.searchsorted(ends, places[:-1], "right")
    text_of = np.array([text for text, _ in held], dtype=np.int64)
    for column in range(4):
        tally.sums[text_of, column] += np.bincount(owner, numbers[code, column], len(held)).astype(np.int64)
    bad = np.bincount(owner, 1 - numbers[code, 4], len(held)) > 0
    written = pa.array(texts, type=pa.large_binary()).take(units.indices)
    offsets = np.frombuffer(written.buffers()[1], dtype=np.int64)[: len(code) + 1]
    data = memoryview(written.buffers()[2] or b"")
    edges = offsets[np.searchsorted(owner, np.arange(len(held) + 1))].tolist()
    for place, (text, _) in enumerate(held):
        if bad[place]:
            tally.fits[text] = False
        if edges[place + 1] > edges[place]:
            # Every unit ends its last group with a semicolon; the last one of a text is left off.
            if tally.begun[text]:
                tally.hashes[text].update(b";")
            tally.hashes[text].update(data[edges[place] : edges[place + 1] - 1])
            tally.begun[text] = True
    # A text's links: first how often each unit occurs in it, then the links of these units.
    pairs, times = np.unique(owner.astype(np.int64) * len(slots) + code, return_counts=True)
    doc, unit = pairs // len(slots), pairs % len(slots)
    flat = np.frombuffer(b"".join(keys), dtype=np.int64)
    lengths = numbers[:, 3]
    n = lengths[unit]
    at = spread((np.cumsum(lengths) - lengths)[unit], n)
    tally.links.append(summed(np.repeat(text_of[doc], n), flat[at], np.repeat(times, n)))


def summed(text: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) in ascending order with the sum of their times."""
    order = np.lexsort((key, text)) if key.max(initial=0) >= 1 << 31 else np.argsort(text << 31 | key, kind="stable")
    text, key, times = text[order], key[order], times[order]
    if not len(text):
        return text, key, times
    new = np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))
    return text[new], key[new], np.add.reduceat(times, np.flatnonzero(new))


_aligners: dict[str, Aligner] = {}


def batch_aligner(models: Models, digest: str) -> Callable[[list], dict]:
    """Columns n_a, n_b, n_groups, n_links, groups_sha256, pairs and times for a list of texts."""

    def align(texts: list) -> dict:
        if digest not in _aligners:
            _aligners[digest] = Aligner(models)
        aligner = _aligners[digest]
        tally = Tally(len(texts))
        held: list[tuple[int, bytes]] = []
        size = 0
        for number, text in enumerate(texts):
            if not text:
                continue
            tally.fits[number] = True
            for place, piece in enumerate(pieces_of(b" " + text.encode(), aligner.models.by_unit)):
                if place or size + len(piece) > SLICE:
                    if held:
                        add_slice(tally, aligner, held)
                    held, size = [], 0
                held.append((number, piece))
                size += len(piece)
        if held:
            add_slice(tally, aligner, held)
        links = summed(*(np.concatenate(side) for side in zip(*tally.links, strict=True))) if tally.links else None
        tally.sums[~tally.fits] = 0
        hashes = [h.hexdigest() if fits else "" for h, fits in zip(tally.hashes, tally.fits, strict=True)]
        columns = dict(zip(("n_a", "n_b", "n_groups", "n_links"), tally.sums.T, strict=True))
        pairs = times = offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        if links is not None:
            kept = tally.fits[links[0]]
            owner, pairs, times = (side[kept] for side in links)
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
        ends = int(offsets[-1])
        for name, values in (("pairs", pairs[:ends]), ("times", times[:ends])):
            columns[name] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
        return columns | {"groups_sha256": hashes}

    return align


ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<long>"
)


def align_texts(df: DataFrame, models: Models, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per text with its counts, the hash of its groups, and its distinct linked id pairs with their times.

    A pair is one number: A id times the number of B ids, plus B id. `row` tells rows of one id apart once stored.
    """
    spark = df.sparkSession
    chosen = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
    )
    shared = spark.sparkContext.broadcast(
        (models.byte_json, models.piece_model, models.byte_tokens, models.piece_tokens, models.by_unit)
    )
    digest = models.digest()
    target = spark.createDataFrame([], ALIGNED).schema
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = batch_aligner(Models(*shared.value), digest)
        for batch in batches:
            for part in parts(batch, column=2):
                columns = align(part.column(2).to_pylist())
                columns |= {"row": part.column(0), "doc_id": part.column(1)}
                yield pa.RecordBatch.from_arrays([as_array(columns[n]) for n in names], names=names)

    return chosen.mapInArrow(run, target)


def as_array(values: pa.Array | np.ndarray | Sequence) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pass that counts pairs: (pair, number of rows that hold it), added up over bounded numbers of links."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy())
        size += len(held[-1])
        if size >= COUNTED_LINKS:
            yield counted(held)
            held, size = [], 0
    if size:
        yield counted(held)


def pair_counts(aligned: DataFrame, n_pieces: int) -> DataFrame:
    """(pair, n, is_best): the number of texts that hold each pair linked, and whether its A id has none with more."""
    partial = aligned.select("pairs").mapInArrow(count_pairs, "pair long, n long")
    counts = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    # An A id has at most as many pairs as there are B ids.
    of_a = Window.partitionBy(F.floor(F.col("pair") / F.lit(n_pieces)))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("is_best"))


def common_pairs(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """`counts` in two: pairs with a count above some limit, at most `most` of them, and the rest."""
    # Sizes by powers of two with eight steps each: a few hundred rows.
    step = F.floor(F.log2("n") * 8).cast("int")
    left, cut = most, None
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        left -= row["count"]
        if left < 0:
            break
        cut = row.step
    return counts.where(step >= F.lit(cut)), counts.where(F.coalesce(step < F.lit(cut), F.lit(True)))


def look_up(pairs: np.ndarray, n: np.ndarray, best: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass over (row, pairs, times) that sums up the links of the given pairs and hands on the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, times = batch.column(1), batch.column(2).flatten().to_numpy()
            sizes = column.value_lengths().to_numpy()
            keys = column.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
            known = pairs[at] == keys if len(pairs) else np.zeros(len(keys), dtype=bool)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            n_best = np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(total, owner[known], times[known] * n[at[known]])
            np.add.at(n_best, owner[known], times[known] * best[at[known]])
            offsets = np.searchsorted(owner[~known], np.arange(batch.num_rows + 1)).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[~known])) for v in (keys, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_best), pa.array(total), *rest],
                names=["row", "n_best", "count_sum", "pairs", "times"],
            )

    return run


def link_sums(aligned: DataFrame, counts: DataFrame, most: int = COMMON_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of stored aligned rows, from stored counts.

    The most frequent pairs, at most `most`, are looked up in a pass; the links of all others are joined.
    """
    common, others = common_pairs(counts, most)
    table = common.orderBy("pair").toArrow()
    columns = [table[c].to_numpy() for c in ("pair", "n", "is_best")]
    shared = aligned.sparkSession.sparkContext.broadcast((columns[0], columns[1], columns[2].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from look_up(*shared.value)(batches)

    schema = "row long, n_best long, count_sum long, pairs array<long>, times array<long>"
    looked = materialize(aligned.select("row", "pairs", "times").mapInArrow(run, schema), "looked_up")
    links = looked.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed(
        {"pairs": "pair", "times": "k"}
    )
    best = F.col("k") * F.col("is_best").cast("int")
    joined_links = links.join(others, "pair").groupBy("row").agg(
        F.sum(best).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more")
    )
    zero = F.lit(0)
    return looked.join(joined_links, "row", "left").select(
        "row",
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", zero)).alias("count_sum"),
    )


def align_documents(
    df: DataFrame,
    byte_path: str,
    piece_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    most: int = COMMON_PAIRS,
) -> DataFrame:
    """One row per text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level vocabulary on a space and the text, B the piece vocabulary on the text, both without special
    tokens. Byte offsets where tokens of both end cut them into groups; links are all pairs of an A and a B token whose
    byte ranges overlap. An id pair's count is the number of texts that hold it linked; `count_sum` adds up the counts
    of a text's links, `n_best` counts the links whose count is the highest of their A id.

    1. A pass cuts texts into units that no token of either vocabulary crosses (words, with white space that is not
       plain left inside), aligns each new unit by pointer jumping (see `groups_of`) and adds up a text's units. What
       it finds is stored with the distinct pairs of every text.
    2. Pairs are counted in tasks first, then shuffled by pair.
    3. A second pass looks up the most frequent pairs, at most `most`, which are broadcast; links of rarer pairs are
       joined with the counts. Nothing is left out.

    Null and empty texts, and texts whose tokens' bytes are not the text (such as those with U+2581) have no tokens:
    zeros and an empty hash column. Rows that share an id, or have none, are texts of their own. Extra columns are not
    read.
    """
    models = read_models(byte_path, piece_path)
    aligned = materialize(align_texts(df, models, id_column, text_column), "aligned")
    counts = materialize(pair_counts(aligned, len(models.piece_tokens)), "pair_counts")
    sums = link_sums(aligned, counts, most)
    return aligned.join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
