"""Ranked search, token alignment and near-duplicate vectors against brute force, and on awkward input."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sessiongraph.llm import lexical_search, token_alignment, vector_duplicates
from sessiongraph.llm.queries import piece_model, tokenizer_file

WORDS = "alpha beta Gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()
DOCUMENTS = "doc_id long, text string, score string, rank int, term string, n int"


def prose(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) for _ in range(n))


# 11: ranked lexical search


def ranked(documents, items, k):
    """(item, rank, doc, score) by the definition."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    counts = [(i, Counter(pattern.findall((t or "").translate(lower)))) for i, t in documents]
    counts = [(i, c) for i, c in counts if c]
    n_all, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    terms: dict[int, set] = {}
    for item, text in items:
        if item is not None:
            terms.setdefault(item, set()).update(pattern.findall((text or "").translate(lower)))
    out = []
    for item, asked in terms.items():
        scores = []
        for doc, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_all // n_terms
            score = 0
            for t in asked & c.keys():
                score += math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (
                    1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)
                )
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, place + 1, doc, -score) for place, (score, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_search_equals_definition(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "PART_DOCUMENTS", 300)
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", 8)
    monkeypatch.setattr(lexical_search, "BOUND_DOCUMENTS", 100)
    draw = random.Random(3)
    rare = [f"w{i}" for i in range(400)]
    documents = [(i, prose(draw, draw.randint(1, 40)) + " " + " ".join(draw.sample(rare, 6))) for i in range(1500)]
    documents += [(i, documents[7][1]) for i in range(2000, 2040)]
    items = [(i, prose(draw, 6) + " " + " ".join(draw.sample(rare, 8))) for i in range(30)] + [(40, documents[7][1])]
    found = lexical_search.rank_documents(
        spark.createDataFrame(documents, "doc_id long, text string").repartition(4),
        spark.createDataFrame(items, "item_id long, text string"),
        5,
        query_bytes=500,
    )
    assert sorted(map(tuple, found.collect())) == ranked(documents, items, 5)


def test_search_on_odd_rows(spark):
    documents = [
        (1, "Alpha, beta! alpha"), (2, None), (3, ""), (4, "?!"), (5, "ÄLPHA alpha_é\x00beta"), (1, "alpha beta"),
        (None, "alpha alpha"), (6, "beta " * 300_000 + "alpha"), (7, "x" * 5_000_000 + " alpha"), (9, "alpha beta"),
        (8, "alpha beta"),
    ]
    items = [(1, "ALPHA beta"), (1, "Ä"), (2, None), (3, "!!"), (None, "alpha"), (4, "alpha_é"), (5, "nowhere")]
    rows = [(*d, "s", 1, "t", 2) for d in documents]
    found = lexical_search.rank_documents(
        spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(items, "item_id long, text string"), 10
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == ranked(documents, items, 10)
    none = spark.createDataFrame([], DOCUMENTS)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.rank_documents(none, asked).count() == 0
    assert lexical_search.rank_documents(asked.withColumnRenamed("item_id", "doc_id"), asked.limit(0)).count() == 0


def test_summaries_bound_all_scores():
    draw = np.random.default_rng(1)
    rows, terms = np.nonzero(draw.random((600, 50)) < 0.3)
    values = draw.integers(1, 1000, len(rows)).astype(np.int32)
    weights = draw.integers(1, 9000, 50)
    part = lexical_search.Part(np.arange(600), rows, terms, values, weights)
    for term in range(50):
        documents, block, summaries = part.blocks(term)
        assert set(documents) == set(rows[terms == term])
        assert (summaries[block] >= part.table[documents]).all()
        assert all((summaries[b] == part.table[documents[block == b]].max(axis=0)).all() for b in set(block))


# 12: alignment of tokens


@pytest.fixture(scope="module")
def models():
    return token_alignment.read_models(tokenizer_file("byte_bpe_50k.json"), piece_model())


@pytest.fixture(scope="module")
def libraries(models):
    import sentencepiece
    from tokenizers import Tokenizer

    byte_level = Tokenizer.from_str(models.byte_json)
    byte_level.encode_special_tokens = True
    return byte_level, sentencepiece.SentencePieceProcessor(model_proto=models.piece_model)


def aligned(models, libraries, text):
    """(n_a, n_b, n_groups, n_links, hash, links) with both libraries on the whole text and plain loops."""
    text = text or ""
    a = libraries[0].encode(" " + text, add_special_tokens=False).ids
    b = libraries[1].encode(text)
    tokens_a, tokens_b = [models.byte_tokens[i] for i in a], [models.piece_tokens[i] for i in b]
    whole = (" " + text).encode()
    if not text or b"".join(tokens_a) != whole or b"".join(tokens_b) != whole:
        return 0, 0, 0, 0, "", {}

    def spans(tokens):
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        return list(zip([0, *ends], ends, strict=False))

    links: Counter = Counter()
    first = 0
    spans_a, spans_b = spans(tokens_a), spans(tokens_b)
    for i, (start, end) in enumerate(spans_a):
        while spans_b[first][1] <= start:
            first += 1
        j = first
        while j < len(b) and spans_b[j][0] < end:
            links[a[i] * len(models.piece_tokens) + b[j]] += 1
            j += 1
    groups, left_a, left_b = [], 0, 0
    for stop in sorted({e for _, e in spans_a} & {e for _, e in spans_b}):
        right_a = sum(1 for _, e in spans_a[left_a:] if e <= stop) + left_a
        right_b = sum(1 for _, e in spans_b[left_b:] if e <= stop) + left_b
        groups.append(",".join(map(str, a[left_a:right_a])) + "|" + ",".join(map(str, b[left_b:right_b])))
        left_a, left_b = right_a, right_b
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
    return len(a), len(b), len(groups), sum(links.values()), digest, dict(links)


PARTS = [
    "a", "the", " ", "  ", "\n", "\n\n", "\t", "é", "word", "Ünï", "😀", " ", "　", "\x00", "▁", "'s", "don't",
    "123", "!?", "<s>", "<|endoftext|>", "<0x41>", "漢字", "\r\n", "\x85", " ", "é ", "\x1c", "\x7f", "​", "א",
    "١٢", ".", " .", " \n", "\n ",
]


def odd_texts(n: int) -> list[str]:
    draw = random.Random(5)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(1, 14))) for _ in range(n)]


def test_alignment_equals_libraries(models, libraries):
    texts = [*odd_texts(1500), "thereon inwards shouldering", None, ""]
    found = token_alignment.batch_aligner(models, models.digest())(texts)
    for i, text in enumerate(texts):
        wanted = aligned(models, libraries, text)
        numbers = tuple(int(found[c][i]) for c in ("n_a", "n_b", "n_groups", "n_links"))
        links = dict(zip(found["pairs"][i].as_py(), found["times"][i].as_py(), strict=True))
        assert (*numbers, found["groups_sha256"][i], links) == wanted, repr(text)


def test_long_texts_are_cut_where_units_end(models, libraries, monkeypatch):
    text = " ".join(odd_texts(300)).replace("▁", "_")
    pieces = list(token_alignment.pieces_of((" " + text).encode(), True, 200))
    assert len(pieces) > 5 and b"".join(pieces) == (" " + text).encode()
    cut = token_alignment.pieces_of
    monkeypatch.setattr(token_alignment, "pieces_of", lambda text, by_unit: cut(text, by_unit, 200))
    found = token_alignment.batch_aligner(models, "cut")(["x", text, text])
    wanted = aligned(models, libraries, text)
    for i in (1, 2):
        assert (int(found["n_links"][i]), found["groups_sha256"][i]) == (wanted[3], wanted[4])
        assert dict(zip(found["pairs"][i].as_py(), found["times"][i].as_py(), strict=True)) == wanted[5]


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_counts_of_links(spark, models, libraries, most):
    draw = random.Random(9)
    texts = [prose(draw, draw.randint(1, 30)) for _ in range(60)] + odd_texts(40)
    texts += [None, "", "▁", texts[0], texts[0], "z" * 30_000, "word " * 5_000]
    rows = [(None if i == 5 else i % 50, t, "s", 1, "t", 2) for i, t in enumerate(texts)]
    found = token_alignment.align_documents(
        spark.createDataFrame(rows, DOCUMENTS), tokenizer_file("byte_bpe_50k.json"), piece_model(), most=most
    )
    each = [aligned(models, libraries, t) for t in texts]
    count = Counter(pair for *_, links in each for pair in links)
    highest: dict[int, int] = {}
    for pair, n in count.items():
        a = pair // len(models.piece_tokens)
        highest[a] = max(highest.get(a, 0), n)
    wanted = []
    for (doc, *_), (n_a, n_b, n_groups, n_links, digest, links) in zip(rows, each, strict=True):
        best = sum(k for p, k in links.items() if count[p] == highest[p // len(models.piece_tokens)])
        total = sum(k * count[p] for p, k in links.items())
        wanted.append((doc, n_a, n_b, n_groups, n_links, best, total, digest))
    key = str
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)
    if most:
        empty = token_alignment.align_documents(
            spark.createDataFrame([], DOCUMENTS), tokenizer_file("byte_bpe_50k.json"), piece_model()
        )
        assert empty.count() == 0


def test_groups_of_a_long_chain():
    # Tokens of two bytes against tokens of two bytes that start one later: one group over all.
    n = 5_000
    a = np.arange(2, 2 * n + 1, 2)
    b = np.append(np.arange(1, 2 * n, 2), 2 * n)
    group_a, group_b, first, links = token_alignment.groups_of(a, b)
    assert set(group_a) == set(group_b) == {0}
    assert links.sum() == 2 * n


# 13: near-duplicate vectors


def linked(rows, similarity):
    """(id, links, component, kept) over all pairs."""
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, dtype=np.float64) / max(abs(x) for x in v)
        return v / math.sqrt(v @ v)

    units = [unit(v) if i is not None else None for i, v in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = units[x] is not None and units[y] is not None and len(units[x]) == len(units[y])
            if both and units[x] @ units[y] >= similarity:
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    least: dict[int, int] = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    out = [(i, links[x], least.get(find(x)), i is None or least[find(x)] == i) for x, (i, _) in enumerate(rows)]
    return sorted(out, key=str)


def near(draw, vector, cosine):
    other = draw.normal(size=len(vector))
    other -= (other @ vector) / (vector @ vector) * vector
    other *= np.sqrt(vector @ vector) / np.sqrt(other @ other)
    return cosine * vector + math.sqrt(1 - cosine**2) * other


def test_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=24).tolist()) for i in range(400)]
    rows += [(1000 + i, near(draw, np.array(rows[i][1]), 0.99).tolist()) for i in range(60)]
    rows += [(2000 + i, (np.array(rows[i % 3][1]) * (1 + i)).tolist()) for i in range(50)]
    rows += [(3000 + i, near(draw, np.array(rows[9][1]), 0.998).tolist()) for i in range(90)]
    rows += [(i, rows[4][1]) for i in (4000, 4001, 4001)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [1.0, None]), (None, rows[0][1])]
    rows += [(5005, [1e300, 1e300]), (5006, [1e-300, 1e-300]), (5007, [2.0, 2.1]), (5008, [float("inf")] * 24)]
    df = spark.createDataFrame([(*r, 1, "n", "k") for r in rows], "vec_id long, embedding array<double>, node int, name string, links string")
    whole = vector_duplicates.near_duplicate_vectors(df, recall=1.0)
    assert sorted(map(tuple, whole.collect()), key=str) == linked(rows, 0.95)
    cut = vector_duplicates.near_duplicate_vectors(df, recall=1.0, list_rows=16, task_rows=64)
    assert sorted(map(tuple, cut.collect()), key=str) == linked(rows, 0.95)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert vector_duplicates.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(2, [1.0, 2.0]), (1, [1.0, 2.1])]
    found = vector_duplicates.near_duplicate_vectors(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


@pytest.mark.parametrize("width", [16, 64, 300])
def test_recall_of_the_index(width):
    """Pairs just above the threshold share enough reference points, among 100,000 vectors' worth of points."""
    draw = np.random.default_rng(4)
    points = draw.normal(size=(vector_duplicates.pivot_count(100_000, width, 3), width))
    points /= np.sqrt((points**2).sum(axis=1, keepdims=True))
    left = draw.normal(size=(1_000, width))
    left /= np.sqrt((left**2).sum(axis=1, keepdims=True))
    nearest = vector_duplicates.nearest_needed(points, left[:500], 0.95, 3, 0.99)
    right = np.array([near(draw, v, 0.951) for v in left])
    found = [np.argsort(-(side @ points.T), axis=1)[:, :nearest] for side in (left, right)]
    shared = (found[0][:, :, None] == found[1][:, None, :]).any(axis=2).sum(axis=1)
    assert (shared >= vector_duplicates.SHARED).mean() > 0.95


def test_recall_over_all_stages(spark):
    """Links found of all pairs at 0.95 or more, by brute force over 3,000 vectors of 64 components."""
    draw = np.random.default_rng(8)
    base = draw.normal(size=(2_000, 64))
    close = np.array([near(draw, base[i], 0.951 + 0.04 * draw.random()) for i in range(1_000)])
    vectors = np.concatenate((base, close))
    unit = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    wanted = (unit @ unit.T >= 0.95).sum() - len(unit)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    found = vector_duplicates.near_duplicate_vectors(df).agg({"n_links": "sum"}).first()[0]
    assert 0.97 * wanted <= found <= wanted
