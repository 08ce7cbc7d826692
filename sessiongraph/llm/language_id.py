"""Language identification by cross-parsing entropy."""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessiongraph.llm.common import kept_rows, text_pass

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNDETERMINED = "und"
# The bounded training sample: texts per language, characters of each of them, and the stretches these come from.
SAMPLE_TEXTS = 60
SAMPLE_CHARACTERS = 1_000
SAMPLE_STRETCHES = 5
# A text is parsed in stretches of this many letters and word gaps, so that all stretches of a batch advance together.
STRETCH = 1_024
LANES = 4_096
# Phrases a character above which a text is in no learned language (see `reject`).
MAX_RATE = 0.45
# Standard deviations by which a text must exceed it: short texts vary more.
MARGIN = 2.0


class SuffixAutomaton:
    """The suffix automaton of a sequence of symbols, as one transition table.

    `step[state * symbols + symbol]` is twice the next state, plus 1 if the match cannot go on: then a new
    phrase starts with this symbol.
    """

    def __init__(self, sequence: Sequence[int], symbols: int) -> None:
        following: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in sequence:
            current = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            state = last
            while state >= 0 and symbol not in following[state]:
                following[state][symbol] = current
                state = link[state]
            if state >= 0:
                target = following[state][symbol]
                if length[state] + 1 == length[target]:
                    link[current] = target
                else:
                    clone = len(following)
                    following.append(dict(following[target]))
                    length.append(length[state] + 1)
                    link.append(link[target])
                    while state >= 0 and following[state].get(symbol) == target:
                        following[state][symbol] = clone
                        state = link[state]
                    link[target] = link[current] = clone
            last = current
        # The last state is that of no match: a new phrase starts after it, and at the start of a text.
        table = np.full((len(following) + 1, symbols), -1, dtype=np.int32)
        for state, edges in enumerate(following):
            for symbol, target in edges.items():
                table[state, symbol] = target
        restart = np.where(table[0] >= 0, table[0], len(following))
        self.step = np.where(table >= 0, table * 2, restart * 2 + 1).astype(np.int32, copy=False).ravel()


def _letter_cases() -> np.ndarray:
    """For each code point its lower-case form, or 0 if it is no letter."""
    out = np.zeros(0x110000, dtype=np.int32)
    for point in range(0x110000):
        character = chr(point)
        if character.isalpha():
            lower = character.lower()
            out[point] = ord(lower) if len(lower) == 1 else point
    return out


class Parser:
    """Cross-parses texts against the automaton of every language."""

    def __init__(self, samples: Mapping[str, str]) -> None:
        self.cases = _letter_cases()
        normalized = {lang: self.letters(text) for lang, text in sorted(samples.items())}
        self.languages = [lang for lang, points in normalized.items() if len(points) > 1]
        known = np.unique(np.concatenate([normalized[lang] for lang in self.languages] or [np.zeros(1, np.int32)]))
        # Symbol 0 is the gap between words, the last one any letter no sample has.
        self.symbols = len(known) + 2
        self.symbol = np.full(0x110000, self.symbols - 1, dtype=np.int32)
        self.symbol[known] = np.arange(1, len(known) + 1)
        self.symbol[0] = 0
        self.automata = [
            SuffixAutomaton(self.symbol[normalized[lang]].tolist(), self.symbols).step for lang in self.languages
        ]

    def letters(self, text: str) -> np.ndarray:
        """Lower-case letters, every other run of characters as one 0."""
        points = self.cases[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
        keep = points > 0
        keep[1:] |= keep[:-1]
        return points[keep]

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(letters and gaps per text, phrases after the first per letter or gap, by text and language)."""
        sizes = np.zeros(len(texts), dtype=np.int64)
        phrases = np.zeros((len(texts), len(self.languages)))
        lanes: list[np.ndarray] = []
        owners: list[int] = []
        for i, text in enumerate(texts):
            points = self.letters(text) if text else np.empty(0, dtype=np.int32)
            if not points.any():
                continue
            sizes[i] = len(points)
            symbols = self.symbol[points]
            for start in range(0, len(symbols), STRETCH):
                lanes.append(symbols[start : start + STRETCH])
                owners.append(i)
            if len(lanes) >= LANES:
                self._parse(lanes, owners, phrases)
                lanes, owners = [], []
        if lanes:
            self._parse(lanes, owners, phrases)
        return sizes, np.maximum(phrases - 1, 0) / np.maximum(sizes, 1)[:, None]

    def _parse(self, lanes: list[np.ndarray], owners: list[int], phrases: np.ndarray) -> None:
        """Add the phrases of all lanes to their texts. Longer lanes come first, so a step is a leading slice."""
        order = sorted(range(len(lanes)), key=lambda k: -len(lanes[k]))
        lengths = np.array([len(lanes[k]) for k in order])
        owner = np.array([owners[k] for k in order])
        grid = np.zeros((int(lengths[0]), len(order)), dtype=np.int32)
        for column, k in enumerate(order):
            grid[: len(lanes[k]), column] = lanes[k]
        active = len(order) - np.searchsorted(lengths[::-1], np.arange(1, len(grid) + 1))
        for language, step in enumerate(self.automata):
            state = np.full(len(order), len(step) // self.symbols - 1, dtype=np.int32)
            count = np.zeros(len(order), dtype=np.int32)
            for symbols, n in zip(grid, active.tolist(), strict=True):
                value = step[state[:n] * np.int32(self.symbols) + symbols[:n]]
                count[:n] += value & 1
                state[:n] = value >> 1
            np.add.at(phrases[:, language], owner, count)


@dataclass(frozen=True)
class Model:
    """A bounded sample of text per language; the automata are built from it once per task."""

    samples: tuple[tuple[str, str], ...]


def predictor(model: Model) -> Callable[[list, list], dict]:
    """The batch function of `identify`. It holds its parser itself, so that a task's parser goes when the task ends."""
    built: list[Parser] = []

    def predict(ids: list, texts: list) -> dict:
        if not built:
            built.append(Parser(dict(model.samples)))
        parser = built[0]
        sizes, rates = parser.rates(texts)
        known = (sizes > 0) & bool(parser.languages)
        out = {"doc_id": ids, "lang_pred": [UNDETERMINED] * len(ids), "score": [0.0] * len(ids), "rate": [None] * len(ids)}
        out["n_letters"] = sizes
        for i in np.flatnonzero(known).tolist():
            best = int(rates[i].argmin())
            lowest = float(rates[i, best])
            others = np.delete(rates[i], best)
            out["lang_pred"][i] = parser.languages[best]
            # The share of phrases saved against the next language.
            next_best = float(others.min()) if len(others) else np.inf
            out["score"][i] = 1 - lowest / next_best if next_best > 0 else 0.0
            out["rate"][i] = lowest
        return out

    return predict


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0


def stretches(text: Column, characters: int, pieces: int = SAMPLE_STRETCHES) -> Column:
    """The whole text up to `characters`, else as many from `pieces` stretches evenly spread from its start to its end."""
    size = max(1, characters // pieces)
    step = (F.length(text) - size) / max(1, pieces - 1)
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(pieces - 1)),
        lambda i: F.substring(text, (F.floor(i * step) + 1).cast("int"), F.lit(size)),
    )
    return F.when(text.isNull() | (F.length(text) <= characters), text).otherwise(F.array_join(cut, "\n"))


def train(
    labelled: DataFrame,
    lang_column: str = "lang",
    text_column: str = "text",
    texts: int = SAMPLE_TEXTS,
    characters: int = SAMPLE_CHARACTERS,
) -> Model:
    """A sample of at most `texts` distinct texts per language, `characters` of each, taken from all over the text.

    Rows with a null language, and null and empty texts, teach nothing; without rows the model knows no language.

    Texts are chosen by their hash, so copies count once and the choice depends on the texts alone. Hashes are
    cut down to a multiple of `texts` per language on the map side before any window.
    """
    usable = labelled.where(F.col(lang_column).isNotNull() & (F.length(text_column) > 0)).select(
        F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("hash")
    )
    hashes = usable.select("lang", "hash").distinct()
    counts = hashes.groupBy("lang").agg(F.count("*").alias("_n"))
    unit = (F.col("hash").cast("double") + 2.0**63) / 2.0**64
    likely = hashes.join(F.broadcast(counts), "lang").where(unit * F.col("_n") <= 4.0 * texts)
    first = Window.partitionBy("lang").orderBy("hash")
    chosen = likely.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= texts)
    found = (
        usable.join(F.broadcast(chosen.select("lang", "hash")), ["lang", "hash"])
        .groupBy("lang", "hash")
        .agg(F.min(stretches(F.col("text"), characters)).alias("text"))
        .orderBy("lang", "hash")
    )
    samples: dict[str, list[str]] = {}
    for row in found.collect():
        samples.setdefault(row["lang"], []).append(row["text"])
    return Model(tuple((lang, "\n".join(parts)) for lang, parts in sorted(samples.items())))


def identify(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rate, n_letters) of every whole text; `n_letters` counts letters and word gaps.

    A suffix automaton per language gives the longest match of its sample at each place; the text is cut greedily
    into such matches (phrases), and the language with the fewest phrases per letter or word gap wins, the first
    by name if equal. `rate` is that number, without the one phrase that any text needs; `score` is one minus its
    ratio to the next language's.
    Null, empty and letterless text, or a model without languages, give `und`, score 0 and null rate. Repeated
    rows are kept; other columns are not read.
    """
    schema = "doc_id long, lang_pred string, score double, rate double, n_letters long"
    return text_pass(df, predictor(model), schema, id_column, text_column)


def reject(df: DataFrame, model: Model, max_rate: float = MAX_RATE, text_column: str = "text") -> DataFrame:
    """`df` without documents in no learned language: no letters, or a `rate` above `max_rate` by more than
    `MARGIN` / sqrt(n_letters). Letters without words give about 0.5, texts of the learned languages less than 0.25;
    short ones that hold a key or a number of codes may come in between. Each row is judged by its own text in the pass
    that reads it, so rows that share an id, or have none, do not go with each other."""
    predict = predictor(model)

    def keeps(texts: list) -> np.ndarray:
        found = predict(list(range(len(texts))), texts)
        rate = np.array([np.nan if r is None else r for r in found["rate"]], dtype=np.float64)
        letters = np.maximum(np.array(found["n_letters"], dtype=np.float64), 1)
        known = np.array([lang != UNDETERMINED for lang in found["lang_pred"]], dtype=bool)
        return known & ~(rate > max_rate + MARGIN / np.sqrt(letters))

    return kept_rows(df, keeps, text_column)
