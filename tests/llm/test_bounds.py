"""Inputs that would fill a task or lose text: repeated tokens, very long units, several layouts on one host."""

from __future__ import annotations

import gc
import hashlib
import pickle
import resource

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sessiongraph.llm import decontamination, html_text, language_id, sentence_pieces


def runs_by_hand(document, item, width):
    """Maximal runs of equal tokens of at least `width`, place by place."""
    out = []
    for d in range(len(document)):
        for i in range(len(item)):
            if document[d] != item[i] or (d and i and document[d - 1] == item[i - 1]):
                continue
            n = 0
            while d + n < len(document) and i + n < len(item) and document[d + n] == item[i + n]:
                n += 1
            if n >= width:
                out.append((d, i, n))
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 7, 1_000_000])
def test_runs_do_not_depend_on_the_pieces(limit, monkeypatch):
    monkeypatch.setattr(decontamination.Seeds.places, "__defaults__", (limit,))
    rng = np.random.default_rng(1)
    for _ in range(20):
        document = rng.integers(0, 3, 40).astype(np.uint64)
        items = [rng.integers(0, 3, n).astype(np.uint64) for n in (12, 9)]
        seeds = decontamination.Seeds(items, 3)
        found = decontamination.maximal_runs(seeds, decontamination.grams(document, 3), np.array([0, 25, 40]))
        rows = sorted(zip(*(x.tolist() for x in found)))
        wanted = [
            (k, i, d + start, p, n)
            for k, (start, stop) in enumerate(((0, 25), (25, 40)))
            for i, item in enumerate(items)
            for d, p, n in runs_by_hand(document[start:stop], item, 3)
        ]
        assert rows == sorted(wanted)


def test_a_long_text_of_one_word_is_tiled_in_bounded_memory():
    tile = decontamination.tiler([(1, "word " * 500), (2, "some other words that are not there")], 5, 0.5)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = tile([10, 11], ["word " * 60_000, "nothing here"])
    assert (found["doc_id"], found["item_id"], found["matched"], found["n_tiles"]) == ([10], [1], [500], [1])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 800_000


def test_long_units_leave_the_cache_and_bytes_bound_it():
    pieces = [("<unk>", 0.0, 2), ("a", -3.0, 1), ("▁", -2.0, 1), ("aa", -1.0, 1), ("▁a", -1.5, 1)]
    cache = sentence_pieces.UnitCache(sentence_pieces.Vocabulary(pieces), limit_bytes=2_000)
    cache.load(["▁a", "▁" + "a" * 5_000])
    assert cache["▁" + "a" * 5_000][0].count(",") >= 2_500
    cache.load(["▁a"])
    assert list(cache) == ["▁a"]
    for n in range(1, 40):
        cache.load(["▁" + "a" * n])
        assert "▁" + "a" * n in cache
        assert len(cache) + len(cache.older) < 20


def test_units_of_a_batch_are_held_in_slices(monkeypatch):
    """However long the texts of a batch are together, the units of a slice of them are held; results stay the same."""
    pieces = [("<unk>", 0.0, 2), ("a", -3.0, 1), ("▁", -2.0, 1), ("aa", -1.0, 1), ("▁a", -1.5, 1)]
    texts = ["a aa  ab" * n for n in range(60)] + [None, "", "b ▁a"]
    whole = sentence_pieces.encoder(pieces)(list(range(len(texts))), texts)
    loaded = []
    load = sentence_pieces.UnitCache.load
    monkeypatch.setattr(
        sentence_pieces.UnitCache, "load", lambda self, units: (loaded.append(len(units)), load(self, units))
    )
    monkeypatch.setattr(sentence_pieces, "SLICE_CHARACTERS", 1_000)
    assert sentence_pieces.encoder(pieces)(list(range(len(texts))), texts) == whole
    assert len(loaded) > 10 and max(loaded) < 1_000
    vocabulary = sentence_pieces.Vocabulary(pieces)
    for text, found in zip(texts, whole["decoded_sha256"], strict=True):
        decoded = vocabulary.decode(vocabulary.encode(text or ""))
        assert found == hashlib.sha256(decoded.encode()).hexdigest()


def test_training_text_comes_from_all_over_a_long_text(spark):
    df = spark.createDataFrame([("short",), ("a" * 500 + "b" * 500 + "c" * 500,), ("",), (None,)], "text string")
    cut = [r[0] for r in df.select(language_id.stretches(F.col("text"), 100)).collect()]
    assert cut[0] == "short" and cut[2] == "" and cut[3] is None
    assert len(cut[1]) == 104 and cut[1].startswith("a" * 20) and cut[1].endswith("c" * 20) and "b" * 20 in cut[1]


LONG = "A sentence of the story with words enough to be running text of a page that people read from start to end."


def test_every_layout_of_a_host_keeps_its_text(spark):
    first = f"<body><div class=w>Weather in town today</div><div class=story><p>{LONG}</p><p>{LONG}</p></div></body>"
    other = f"<body><div class=story>Weather in town today</div><article><p>{LONG}</p><p>{LONG} Two.</p></article></body>"
    pages = [(i, "https://host.org/a", first if i < 6 else other) for i in range(10)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert all(LONG in found[i] for i in range(6))
    assert all(found[i].endswith(f"{LONG}\n{LONG} Two.") for i in range(6, 10))


def test_article_header_and_inline_elements_stay(spark):
    html = (
        f"<body><header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</p>"
        f"<p>Press <button>Go</button> and <label>name</label> <svg><text>x</text></svg>done.</p></article></body>"
    )
    df = spark.createDataFrame([(1, None, html)], "page_id long, url string, html string")
    assert html_text.main_text(df).first().text == f"Title\n{LONG}\nPress Go and name done."


def test_parsers_and_caches_go_with_their_task():
    """A worker unpickles the function of each task; what it has built goes with it, without a garbage collection."""
    pieces = [("<unk>", 0.0, 2), ("a", -3.0, 1), ("▁", -2.0, 1), ("aa", -1.0, 1), ("▁a", -1.5, 1)]
    model = language_id.Model((("x", "some words of it"), ("y", "other terms")))
    kinds = ("Parser", "UnitCache", "Vocabulary")
    alive = lambda: sum(type(o).__name__ in kinds for o in gc.get_objects())
    tasks = [cloudpickle.dumps(f) for f in (language_id.predictor(model), sentence_pieces.encoder(pieces), sentence_pieces.id_lists(pieces))]
    gc.collect()
    before = alive()
    gc.disable()
    try:
        for task in tasks * 3:
            pickle.loads(task)([1], ["a aa some words"])
        assert alive() == before
    finally:
        gc.enable()
