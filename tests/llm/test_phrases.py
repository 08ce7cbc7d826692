from __future__ import annotations

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sessiongraph.llm import context_mixing, phrases
from sessiongraph.llm.common import separator_table, word_hashes

SCHEMA = "doc_id long, text string, lang string"


def cut_texts(texts):
    hashes, offsets = word_hashes([t.encode().lower() for t in texts], separator_table())
    return phrases.cut(hashes, np.diff(offsets))


def test_phrases_of_equal_runs_are_equal():
    rng = np.random.default_rng(3)
    words = [f"w{n}" for n in rng.integers(0, 500, 400)]
    shared = " ".join(words[100:300])
    found = cut_texts([" ".join(words), "", "before it " + shared + " after it", "one"])
    assert found.owner.tolist() == sorted(found.owner.tolist()) and set(found.owner) == {0, 2, 3}
    first = set(zip(found.context[found.owner == 0].tolist(), found.phrase[found.owner == 0].tolist(), strict=True))
    other = list(zip(found.context[found.owner == 2].tolist(), found.phrase[found.owner == 2].tolist(), strict=True))
    assert len(other) - 4 <= sum(pair in first for pair in other) < len(other)
    assert not found.has_context[found.owner == 3].any()


def test_order_and_end_belong_to_a_phrase():
    found = cut_texts(["a b", "b a", "a b"])
    assert found.phrase[0] != found.phrase[1] and found.phrase[0] == found.phrase[2]


def texts_for(seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    vocabulary = [f"word{n}" for n in range(40)]
    plain = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) for _ in range(60)]
    rows = [(i, t, "x" if i % 2 else "y") for i, t in enumerate(plain)]
    rows += [(100 + i, plain[i], "x") for i in range(20)] + [(200, "same " * 500, None), (201, "same " * 300, None)]
    return rows + [(300, None, "x"), (301, "", None), (None, plain[0], None), (300, plain[1], "y")]


def brute_gains(rows, trained):
    """Per row: what the phrase decisions of a whole text add, from lists and dictionaries."""
    at = [
        list(zip(f.context.tolist(), f.phrase.tolist(), f.has_context.tolist(), strict=True))
        for f in (cut_texts([r[1] or ""]) for r in rows)
    ]
    after = defaultdict(Counter)
    for phrases_of_row, own in zip(at, trained, strict=True):
        if own:
            for context, phrase, keyed in phrases_of_row:
                if keyed:
                    after[context][phrase] += 1
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    favourite = {c: max(((n, signed(p)) for p, n in held.items())) for c, held in after.items()}
    out = []
    for phrases_of_row, own in zip(at, trained, strict=True):
        met = []
        for context, phrase, keyed in phrases_of_row:
            if keyed and context in favourite:
                n, best = favourite[context]
                hit = signed(phrase) == best
                n, total = n - (hit and own), sum(after[context].values()) - own
                if n > 0:
                    met.append((hit, n, total))
        out.append(met)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_gains_equal_brute_force(spark, seed):
    rows = texts_for(seed)
    trained = [r[0] is None or r[0] % 5 != 0 for r in rows]
    df = spark.createDataFrame([(i, r[1], t) for i, (r, t) in enumerate(zip(rows, trained, strict=True))], "i long, text string, t boolean")
    learned = phrases.learn(df.where("t"))
    chance = {(r[0], r[1]): r[2] for r in learned.chances.collect()}
    grade = lambda n: int(math.floor(math.log2(n + 1) * phrases.GRADES_PER_DOUBLING))
    listed = []
    for i, (row, own) in enumerate(zip(rows, trained, strict=True)):
        found = cut_texts([row[1] or ""])
        signed = [a.view(np.int64).tolist() for a in (found.context, found.phrase)]
        listed += [
            (i, int(own), (c, p, -2.5)) for c, p, k in zip(*signed, found.has_context.tolist(), strict=True) if k
        ]
    found = spark.createDataFrame(listed, "_row long, own int, _p struct<context:long,phrase:long,cost:float>")
    sums = {r[0]: r[1] for r in phrases.gains(found, learned).groupBy("_row").sum("gain").collect()}
    wanted = {}
    for i, met in enumerate(brute_gains(rows, trained)):
        parts = [
            math.log10(chance[grade(n), grade(total)]) + 2.5 if hit else math.log10(1 - chance[grade(n), grade(total)])
            for hit, n, total in met
        ]
        if parts:
            wanted[i] = sum(parts)
    assert len(wanted) > 20 and sums.keys() == wanted.keys()
    assert all(abs(sums[i] - wanted[i]) < 1e-6 for i in wanted)


def test_repeats_are_told_from_other_texts(spark):
    rows = texts_for(4)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' n", "'b' token", "1 context")
    model, tokens = context_mixing.train(df)
    scored = {
        (r["doc_id"], round(r["base_score"], 4)): r["score"] / r["base_score"]
        for r in context_mixing.score(df, model, tokens, trained=context_mixing.F.lit(True)).collect()
    }
    assert len(context_mixing.score(df, model, tokens).collect()) == len(rows)
    share = {key[0]: value for key, value in scored.items() if key[0] is not None and key[1] < -40}
    twice = [v for k, v in share.items() if 100 <= k < 120]
    once = [v for k, v in share.items() if 20 <= k < 60]
    assert max(twice) < np.median(once)


def test_held_out_texts_cost_less_than_by_token_counts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = context_mixing.held_out()
    model, tokens = context_mixing.train(documents.where(~held_out))
    scored = context_mixing.score(documents.where(held_out), model, tokens)
    base, score = scored.groupBy().sum("base_score", "score").first()
    assert base < score < 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b c d e f g h", None), (2, None, None)], SCHEMA)
    model, tokens = context_mixing.train(empty)
    assert context_mixing.score(empty, model, tokens).count() == 0
    rows = context_mixing.score(some, model, tokens).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 9]
    assert all(r["n_known"] == 0 and r["score"] < 0 for r in rows)


def test_decisions_keep_within_probability():
    chance = phrases.chances([(2, 2, 90.0, 100.0), (3, 4, 5.0, 40.0), (2, 20, 0.0, 1e9)])
    assert all(0 < p < 1 for p in chance.values())
    assert abs(chance[2, 2] - 0.9) < 0.05 and chance[2, 20] < 1e-3


def test_counts_by_group_and_bytes_come_from_one_table(spark):
    rows = [(1, "Ab b\tab", "x"), (2, "ab é", "y"), (3, None, "x"), (4, "", None), (5, "b\x0bab", "x")]
    model, tokens = context_mixing.train(spark.createDataFrame(rows, SCHEMA))
    counted = {bytes(r["token"]): r["n"] for r in tokens.collect()}
    assert counted == {b"ab": 4, b"b": 2, "é".encode(): 1, b"\n": 5}
    assert (model.train_tokens, model.distinct, model.frequent) == (12, 4, counted)
    by_group = {token: model.group_counts[:3, i].tolist() for i, token in enumerate(model.frequent)}
    assert by_group == {b"ab": [0, 3, 1], b"b": [0, 2, 0], "é".encode(): [0, 0, 1], b"\n": [1, 3, 1]}
    assert model.group_texts[:3].tolist() == [1, 3, 1]
    seen = np.zeros(256)
    for token, n in counted.items():
        seen += n * np.bincount(np.frombuffer(token, dtype=np.uint8), minlength=256)
    seen[context_mixing.TERMINATOR] = 12
    assert [c.tolist() for c in model.code] == [c.tolist() for c in context_mixing.byte_code(seen)]


def test_a_task_that_counts_holds_its_table_and_one_batch():
    rng = np.random.default_rng(5)
    words = [bytes(w) for w in rng.integers(97, 123, (60_000, 9), dtype=np.uint8)]
    code = context_mixing.byte_code(np.arange(256) ** 2)
    columns = [pa.array([context_mixing.TOKEN] * len(words), pa.int32()), pa.array([0] * len(words), pa.int32())]
    columns += [pa.array(words, pa.binary()), pa.array([1] * len(words), pa.int64())]
    batch = pa.RecordBatch.from_arrays(columns, names=["kind", "group", "token", "n"])
    tracemalloc.start()
    total = np.zeros(2)
    for block in context_mixing.counter(code, 2)(iter([batch])):
        total += np.frombuffer(block.column(1)[0].as_py(), dtype=np.float32).reshape(2, -1).sum(axis=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    decisions = context_mixing.PREDICTORS * sum(
        int(code[0][list(w + bytes([context_mixing.TERMINATOR]))[1:]].sum()) for w in words
    )
    assert total.sum() == decisions
    assert peak < 170_000_000


def test_listed_tokens_of_a_text_are_counted():
    texts = ["a rare rare\nb", None, "", "a a rareR"]
    model = context_mixing.Model(
        np.zeros((2, 1 << context_mixing.SLOT_BITS), dtype=np.uint16),
        context_mixing.Mixer(),
        context_mixing.byte_code(np.ones(256)),
        {b"a": 5},
        np.zeros((context_mixing.GROUPS, 1), dtype=np.float32),
        np.zeros(context_mixing.GROUPS),
        2,
        9,
        3,
    )
    model.table = context_mixing.prepare(model.table)
    part = pa.RecordBatch.from_arrays(
        [pa.array(range(4), pa.int64()), pa.array(texts), pa.array([0] * 4, pa.int32())], names=["doc_id", "text", "own"]
    )
    rows = context_mixing.score_part(part, context_mixing.TokenCosts(model)).to_pylist()
    wanted = [{b"rare": 2, b"b": 1, b"\n": 1}, {b"\n": 1}, {b"\n": 1}, {b"rarer": 1, b"\n": 1}]
    assert [{e["token"]: e["n"] for e in r["rare"]} for r in rows] == wanted
    assert [(r["n_tokens"], r["known"]) for r in rows] == [(5, 1), (1, 0), (1, 0), (4, 2)]
