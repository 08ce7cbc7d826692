"""Encoding and decoding with a merge-type SentencePiece vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from sessiongraph.llm.common import text_pass

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
# Piece types of the model file.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
CACHED_UNITS = 400_000
# Longer units are not kept, and a generation of the cache ends at about so many bytes of entries.
CACHED_LENGTH = 64
CACHED_BYTES = 150_000_000
# Characters whose units are held at once, unless one text has more.
SLICE_CHARACTERS = 500_000
# Longer units have an agenda of their own.
SHORT_UNIT = 40
AGENDA_ROWS = 20_000


class Vocabulary:
    """Pieces, scores and byte pieces of a model file without text normalization rules."""

    def __init__(self, pieces: Sequence[tuple[str, float, int]]) -> None:
        self.rank = {p: (i, -score) for i, (p, score, kind) in enumerate(pieces) if kind == NORMAL}
        self.of_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.of_byte.items()}
        self.text = [p.replace(SPACE, " ") if kind == NORMAL else "" for p, _, kind in pieces]
        unknown = [i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN]
        self.unknown = unknown[0] if unknown else -1
        self.joined = {c for p in self.rank if len(p) > 1 for c in p}
        self.known = {p for p in self.rank if len(p) == 1}
        self.char_piece = np.full(0x110000, -1, dtype=np.int64)
        for p in self.known:
            self.char_piece[ord(p)] = self.rank[p][0]
        self.order = np.array([-score for _, score, _ in pieces])
        splits = [
            (self.rank[p[:cut]][0] * len(pieces) + self.rank[p[cut:]][0], i)
            for p, (i, _) in self.rank.items()
            for cut in range(1, len(p))
            if p[:cut] in self.rank and p[cut:] in self.rank
        ]
        splits.sort()
        self.pair_keys = np.array([key for key, _ in splits] or [-1], dtype=np.int64)
        self.pair_pieces = np.array([i for _, i in splits] or [-1], dtype=np.int64)
        # A unit ends before a space mark if no piece has one after another character.
        self.by_space = not any(SPACE in p.lstrip(SPACE) for p in self.rank)

    def encode_unit(self, unit: str) -> list[int]:
        """Merge adjacent symbols by score, best first, leftmost of equals, until no pair is a piece.

        The agenda holds each pair that is a piece, with the symbols' texts at that time; entries whose
        symbols have changed since are dropped when they come up.
        """
        symbols: list[str] = list(unit)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.rank
        agenda: list[tuple[float, int, int, str]] = []
        for left in range(n - 1):
            merged = symbols[left] + symbols[left + 1]
            if merged in rank:
                agenda.append((rank[merged][1], left, left + 1, merged))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, merged = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != merged:
                continue
            symbols[left], symbols[right] = merged, ""
            following = after[left] = after[right]
            if following >= 0:
                before[following] = left
                pair = merged + symbols[following]
                if pair in rank:
                    heapq.heappush(agenda, (rank[pair][1], left, following, pair))
            previous = before[left]
            if previous >= 0:
                pair = symbols[previous] + merged
                if pair in rank:
                    heapq.heappush(agenda, (rank[pair][1], previous, left, pair))
        ids: list[int] = []
        for symbol in symbols:
            if not symbol:
                continue
            if symbol in rank:
                ids.append(rank[symbol][0])
            elif self.of_byte:
                ids.extend(self.of_byte[b] for b in symbol.encode())
            else:
                ids.append(self.unknown)
        return ids

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """`encode_unit` of many units. Short ones share one agenda: a table of the scores of their adjacent
        pairs, of which each round takes the best (leftmost) entry of every unit that has one."""
        out: list[list[int]] = [[]] * len(units)
        short = []
        for place, unit in enumerate(units):
            if len(unit) > SHORT_UNIT or not self.known.issuperset(unit):
                out[place] = self.encode_unit(unit)
            else:
                short.append(place)
        for start in range(0, len(short), AGENDA_ROWS):
            chosen = short[start : start + AGENDA_ROWS]
            for place, ids in zip(chosen, self._encode_short([units[p] for p in chosen]), strict=True):
                out[place] = ids
        return out

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece number and agenda order (infinite if there is no such piece) of adjacent symbols."""
        key = left * len(self.text) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        merged = np.where(found, self.pair_pieces[at], -1)
        return merged, np.where(found, self.order[merged], np.inf)

    def _encode_short(self, units: list[str]) -> list[list[int]]:
        n = len(units)
        lengths = np.array([len(u) for u in units])
        width = int(lengths.max()) + 1
        symbols = np.full((n, width), -1, dtype=np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
        symbols[np.arange(width) < lengths[:, None]] = self.char_piece[points]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        merged, agenda = self._pair(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(n)
        while len(rows):
            best = agenda[rows].argmin(axis=1)
            alive = np.isfinite(agenda[rows, best])
            rows, best = rows[alive], best[alive]
            gone = after[rows, best]
            following = after[rows, gone]
            symbols[rows, best] = merged[rows, best]
            symbols[rows, gone] = -1
            after[rows, best] = following
            before[rows, np.minimum(following, width - 1)] = best
            inner = gone < width - 1
            agenda[rows[inner], gone[inner]] = np.inf
            for left in (best, before[rows, best]):
                has = left >= 0
                at, spot = rows[has], left[has]
                next_symbol = np.minimum(after[at, spot], width - 1)
                merged[at, spot], agenda[at, spot] = self._pair(symbols[at, spot], symbols[at, next_symbol])
        counts = (symbols >= 0).sum(axis=1)
        flat = symbols[symbols >= 0].tolist()
        stops = np.cumsum(counts).tolist()
        return [flat[stop - count : stop] for stop, count in zip(stops, counts.tolist(), strict=True)]

    def units(self, text: str) -> list[str]:
        """The text with its dummy space in front, cut where no merge can reach across."""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_space:
            return [marked]
        if "\n" in self.joined or SPACE + SPACE in marked or "\0" in text:
            return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked)
        cut = marked.replace(SPACE, "\0" + SPACE).replace("\n", "\0\n\0").split("\0")
        return [u for u in cut if u]

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.units(text) for i in self.encode_unit(unit)] if text else []

    def decode(self, ids: Sequence[int]) -> str:
        """Piece texts with spaces for space marks, less the dummy space; runs of byte pieces as UTF-8."""
        return self.decode_part(ids)[1:] if self._starts_with_space(ids) else self.decode_part(ids)

    def _starts_with_space(self, ids: Sequence[int]) -> bool:
        return bool(len(ids)) and self.text[ids[0]].startswith(" ")

    def decode_part(self, ids: Sequence[int]) -> str:
        texts = [self.text[i] for i in ids]
        if all(texts):
            return "".join(texts)
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(" ⁇ " if i == self.unknown else self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


class UnitCache(dict):
    """Ids as text per unit, and its decoded text where that is not its own, in two generations so that frequent units
    stay.

    A generation is bounded in entries and in bytes; units of more than `CACHED_LENGTH` characters stay for one call.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = CACHED_UNITS, limit_bytes: int = CACHED_BYTES) -> None:
        super().__init__()
        self.vocabulary, self.limit, self.older = vocabulary, limit, {}
        self.limit_bytes, self.bytes, self.passing = limit_bytes, 0, []

    def load(self, units: list[str]) -> None:
        """Make sure that all `units` have an entry."""
        for unit in self.passing:
            self.pop(unit, None)
        self.passing = [unit for unit in set(units) if len(unit) > CACHED_LENGTH]
        missing = set(units).difference(self)
        if not missing:
            return
        if len(self) + len(missing) > self.limit or self.bytes > self.limit_bytes:
            self.bytes = 0
            self.older = {unit: self[unit] for unit in set(units).intersection(self)} | (
                dict(self) if len(self) <= self.limit else {}
            )
            self.clear()
            missing = set(units)
        kept = self.older
        fresh = []
        for unit in missing:
            if unit in kept:
                self[unit] = kept[unit]
            else:
                fresh.append(unit)
        decode = self.vocabulary.decode_part
        for unit, ids in zip(fresh, self.vocabulary.encode_units(fresh), strict=True):
            numbers, decoded = ",".join(map(str, ids)), decode(ids)
            self[unit] = (numbers,) if decoded == _own_text(unit) else (numbers, decoded)
        # Two strings, a tuple and a slot take some 300 bytes beside their characters.
        self.bytes += sum(300 + len(u) + sum(map(len, self[u])) for u in missing if len(u) <= CACHED_LENGTH)


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file; it must be a merge model without normalization rules."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as source:
        model.ParseFromString(source.read())
    rules = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
        raise ValueError("only merge models that leave the text as it is")
    if any(p.type == 4 for p in model.pieces):
        raise ValueError("user-defined pieces are not supported")
    return [(p.piece, p.score, p.type) for p in model.pieces]


def _cache(pieces: Sequence[tuple[str, float, int]], built: list[UnitCache]) -> UnitCache:
    if not built:
        built.append(UnitCache(Vocabulary(pieces)))
    return built[0]


def _own_text(unit: str) -> str:
    return unit.replace(SPACE, " ")


def _encoded(cache: UnitCache, texts: list) -> Iterator[list[tuple[str, tuple]]]:
    """(unit, entry) of the units of each text; units of about `SLICE_CHARACTERS` are held at once."""
    held: list[list[str]] = []
    size = 0
    for place, text in enumerate(texts):
        held.append(cache.vocabulary.units(text) if text else [])
        size += len(text or "")
        if size >= SLICE_CHARACTERS or place + 1 == len(texts):
            cache.load([u for row in held for u in row])
            for row in held:
                yield [(u, cache[u]) for u in row]
            held, size = [], 0


def encoder(pieces: Sequence[tuple[str, float, int]]) -> Callable[[list, list], dict]:
    """The batch function of `encode_documents`. It holds its vocabulary and cache itself, so that they go when the task
    ends."""
    built: list[UnitCache] = []

    def encode(ids: list, texts: list) -> dict:
        counts, id_hashes, text_hashes = [], [], []
        for entries in _encoded(_cache(pieces, built), texts):
            numbers = ",".join([e[0] for _, e in entries])
            decoded = "".join([_own_text(u) if len(e) == 1 else e[1] for u, e in entries])
            decoded = decoded[1:] if decoded.startswith(" ") else decoded
            counts.append(numbers.count(",") + 1 if numbers else 0)
            id_hashes.append(hashlib.sha256(numbers.encode()).hexdigest())
            text_hashes.append(hashlib.sha256(decoded.encode()).hexdigest())
        return {"doc_id": ids, "n_tokens": counts, "ids_sha256": id_hashes, "decoded_sha256": text_hashes}

    return encode


def id_lists(pieces: Sequence[tuple[str, float, int]]) -> Callable[[list, list], dict]:
    """The batch function of `tokenize`, see `encoder`."""
    built: list[UnitCache] = []

    def encode(ids: list, texts: list) -> dict:
        rows = _encoded(_cache(pieces, built), texts)
        return {"doc_id": ids, "ids": [[int(i) for _, e in row for i in e[0].split(",")] for row in rows]}

    return encode


def tokenize(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; null and empty text give an empty list."""
    return text_pass(
        df, id_lists(read_vocabulary(model_path)), "doc_id long, ids array<int>", id_column, text_column
    )


def encode_documents(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token count, hash of the ids and hash of the text decoded from them, for every whole text.

    Null text counts as empty: no tokens, hashes of nothing. Repeated rows are kept. Extra columns are not read.
    Units (a word with its spaces) are encoded once and kept in a bounded cache per task; a text of one
    long unit takes n log n steps.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return text_pass(df, encoder(read_vocabulary(model_path)), schema, id_column, text_column)
