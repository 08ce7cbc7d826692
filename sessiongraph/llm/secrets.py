"""Secret scan: candidate strings, and a random forest that removes false positives."""

from __future__ import annotations

import random
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.llm.common import parts
from sessiongraph.session import materialize, new_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A candidate by its form: 16 or more characters of keys and encodings, at least one of them a digit, or an access key id.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b")
# Candidates by their place or beginning, of any form and length: private keys as a whole (up to their end, or as far as
# the encoded lines go), passwords of URLs, values of keys that name a secret, known prefixes of keys.
_KEY_NAME = (
    r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|credential|authorization|bearer"
    r"|(?:api|access|private|auth|signing|secret|account|encryption|master|session|client|service|shared)[_\-]?key)"
    r"[sS]?(?![a-z])[A-Za-z0-9_\-]{0,40}"
)
PLACED = re.compile(
    r"(?P<pem>-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^\-]|-(?!----))*-----END [A-Z0-9 ]{1,60}-----|(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})*))"
    r"|://[^\s/:@\"'<>]*:(?P<url>[^\s/\"'<>]+)(?=@)"
    r"|(?<=[?&])" + _KEY_NAME + r"=(?P<query>[^\s&#\"'`<>]+)"
    r"|" + _KEY_NAME + r"[\"'`\]]{0,2}[ \t]*(?::=|=>|[=:])[ \t]*(?:(?i:bearer|basic|token)[ \t]+)?(?![\"'`]?-----BEGIN )"
    r"(?:\"(?P<double>(?:[^\"\\\n]|\\.)+)\"|'(?P<single>(?:[^'\\\n]|\\.)+)'|`(?P<back>[^`\n]+)`"
    r"|[\"'`]?(?P<bare>[^\s\"'`]*[^\s\"'`.,;)\]}>]))"
    r"|(?<![A-Za-z0-9_\-])(?P<prefix>(?:gh[opsur]_|github_pat_|glpat-|sk-|[sr]k_live_|xox[abprs]-|AIza|ya29\.|npm_|eyJ)"
    r"[A-Za-z0-9_\-][A-Za-z0-9_.\-]{6,}[A-Za-z0-9_\-])"
)
# Every match of PLACED holds one of these, in any case; texts without them need no search for it.
HOLDS = (
    "passw passphrase pwd secret token credential authorization bearer -----begin :// gho_ ghp_ ghs_ ghu_ ghr_ github_pat_ "
    "glpat- sk- sk_live_ rk_live_ xoxa- xoxb- xoxp- xoxr- xoxs- aiza ya29. npm_ eyj"
).split()
HOLDS += [f"{name}{sep}key" for name in "api access private auth signing account encryption master session client service shared".split() for sep in ("", "_", "-")]
KINDS = {"double": "key", "single": "key", "back": "key", "bare": "key", "query": "key"}
BEFORE, AFTER = 32, 16
TRAINING_FINDINGS = 20_000
TREES, DEPTH, SEED = 24, 6, 7
THRESHOLD = 0.5
MASK = "[secret]"

# Words of keys that hold secrets, of other identifiers, and frequent English bigrams.
SECRET_WORDS = (
    "access api apikey auth authorization bearer client credential credentials key passwd password private pwd "
    "secret session sig signature signing token"
).split()
OTHER_WORDS = "build checksum commit digest etag guid hash id image md5 revision serial sha sha1 sha256 uuid version".split()
SECRET_PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- sk- sk_live_ rk_live_ xoxb- xoxp- AIza ya29 npm_ eyJ".split()
PATH_WORDS = "cert config credential env ini key lock pem secret settings test vendor yaml yml".split()
COMMON_BIGRAMS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne "
    "ea ra ce li ch ll be ma si om ur"
).split()

FEATURES = (
    "length",
    "entropy",
    "digits",
    "upper",
    "class_changes",
    "only_hex",
    "only_digits",
    "bigram_coverage",
    "longest_letters",
    "word_coverage",
    "assigned",
    "quoted",
    "secret_word_before",
    "other_word_before",
    "secret_word_near",
    "known_prefix",
    "path_words",
    "symbols",
    "placed",
    "placeholder",
    "prose_after",
)

_WORD = re.compile(r"[A-Za-z]+")
_KEY = re.compile(r"([A-Za-z_][A-Za-z0-9_\-]*)[\"']?\s*(?::=|=>|[=:])\s*[\"'`]?$|\b([A-Za-z]+)\s+[\"'`]?$")
_RUNS = re.compile(r"[A-Za-z]+")
# What stands for a value: names of types and nothings, variables, calls, masks.
PLACEHOLDER = (
    r"(?i)^(?:none|null|nil|true|false|undefined|string|str|text|int|required|optional|passwords?|secret|token|example"
    r"|changeme|redacted|[*x.#_\-]+|[$<{%].*|[a-z_][a-z0-9_.]*[(\[].*|(?:os|process|env|self|this|config|settings)\..*"
    r"|your[_ \-].*)$"
)
_PLACEHOLDER = re.compile(PLACEHOLDER, re.DOTALL)
_PROSE = re.compile(r"[.,;]?[ \t]+[a-z]")


@dataclass
class Finding:
    start: int
    value: str
    before: str
    after: str
    kind: str = "run"


def candidates(text: str) -> Iterator[Finding]:
    """Candidates in order of their start. Those by place come first, those by form fill what is left."""
    low = text.casefold()
    placed = PLACED.finditer(text) if any(word in low for word in HOLDS) else ()
    spans = [(*m.span(m.lastgroup), KINDS.get(m.lastgroup, m.lastgroup)) for m in placed]
    next_span = 0
    for found in CANDIDATE.finditer(text):
        start, stop = found.span()
        while next_span < len(spans) and spans[next_span][1] <= start:
            yield _finding(text, *spans[next_span])
            next_span += 1
        if next_span == len(spans) or stop <= spans[next_span][0]:
            yield _finding(text, start, stop, "run")
    for span in spans[next_span:]:
        yield _finding(text, *span)


def _finding(text: str, start: int, stop: int, kind: str) -> Finding:
    return Finding(start, text[start:stop], text[max(0, start - BEFORE) : start], text[stop : stop + AFTER], kind)


def _kind(character: str) -> int:
    return 0 if character.isdigit() else 1 if character.islower() else 2 if character.isupper() else 3


def features(finding: Finding, path: str | None) -> list[float]:
    """Numbers about length, character transitions, dictionary coverage, path and neighbouring words."""
    value = finding.value
    n = len(value)
    raw = np.frombuffer(value.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.unique(raw, return_counts=True)[1] / len(raw)
    kinds = [_kind(c) for c in value]
    low = value.lower()
    pairs = [low[i : i + 2] for i in range(n - 1)]
    runs = _RUNS.findall(low)
    words = sum(len(r) for r in runs if r in _DICTIONARY)
    key = _KEY.search(finding.before)
    named = {w.lower() for w in _WORD.findall((key[1] or key[2]) if key else "")}
    near = {w.lower() for w in _WORD.findall(finding.before + " " + finding.after)}
    # The place of a private key or a URL's password names it as a key's name does.
    by_place = finding.kind in ("pem", "url", "key")
    in_path = {w.lower() for w in _WORD.findall(path or "")}
    return [
        float(n),
        float(-(counts * np.log2(counts)).sum()),
        kinds.count(0) / n,
        kinds.count(2) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        float(kinds.count(0) == n),
        sum(p in _BIGRAMS for p in pairs) / max(1, len(pairs)),
        float(max(map(len, runs), default=0)),
        words / n,
        float(by_place or bool(key and key[1])),
        float(finding.before[-1:] in ("'", '"', "`") and finding.before != ""),
        float(by_place or not named.isdisjoint(_SECRETS)),
        float(not named.isdisjoint(_OTHERS)),
        float(by_place or not near.isdisjoint(_SECRETS)),
        float(value.startswith(tuple(SECRET_PREFIXES))),
        float(not in_path.isdisjoint(_PATHS)),
        sum(not c.isalnum() for c in value) / n,
        float(finding.kind != "run"),
        float(_PLACEHOLDER.match(value) is not None),
        float(_PROSE.match(finding.after) is not None),
    ]


_BIGRAMS, _SECRETS, _OTHERS, _PATHS = map(frozenset, (COMMON_BIGRAMS, SECRET_WORDS, OTHER_WORDS, PATH_WORDS))
_DICTIONARY = _SECRETS | _OTHERS | _PATHS | frozenset("com example http https mail net org the user www".split())


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("doc_id", "path", "start", "value", "before", "after", "features", "kind")}
        for doc_id, text, path in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for found in candidates(text or ""):
                row = doc_id, path, found.start, found.value, found.before, found.after, features(found, path), found.kind
                for column, value in zip(out, row, strict=True):
                    out[column].append(value)
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string()]
        columns = [pa.array(v, type=k) for v, k in zip(out.values(), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=list(out))


def _inputs(df: DataFrame, id_column: str, text_column: str, path_column: str | None) -> DataFrame:
    path = F.col(path_column).cast("string") if path_column else F.lit(None).cast("string")
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), path.alias("path"))


FOUND = (
    "doc_id long, path string, start int, value string, before string, after string, features array<double>, kind string"
)


def find_candidates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str | None = None
) -> DataFrame:
    """(doc_id, path, start, value, before, after, features, kind) of every candidate of every whole text."""
    return _inputs(df, id_column, text_column, path_column).mapInArrow(_findings, FOUND)


def example_texts(copies: int = 60) -> list[str]:
    """Made-up texts with secrets and what looks like them, so that kinds a corpus hardly shows are learnt as well."""
    draw = random.Random(SEED)
    letters = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
    pick = lambda pool, low, high: "".join(draw.choice(pool) for _ in range(draw.randint(low, high)))
    word = lambda: "".join(draw.choice(COMMON_BIGRAMS) for _ in range(draw.randint(2, 5)))
    texts = []
    for _ in range(copies):
        key = draw.choice(("password", "DB_PASSWORD", "passwd", "api_key", "client_secret", "secret", "auth_token", "userPassword"))
        quote = draw.choice("\"'")
        mixed = f"{word()}{draw.randint(0, 999)}{word().title()}{draw.choice('!$.&?*')}"
        lines = "\n".join(pick(letters + "0123456789+/", 64, 64) for _ in range(draw.randint(4, 24)))
        texts += [
            f"{key} = {quote}{mixed}{quote}\n",
            f"{key}: {quote}{pick(letters, 8, 40)}{quote}, ",
            f"{key}={pick(letters + '0123456789', 8, 40)}\n",
            f"{key} = {quote}{word()}{quote}\n",
            f"{word()}://{word()}:{draw.choice((mixed, word(), pick(letters + '0123456789', 6, 20)))}@{word()}/{word()} ",
            f"-----BEGIN {draw.choice(('RSA ', 'EC ', '', 'OPENSSH '))}PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----\n",
            f"{draw.choice(('ghp_', 'glpat-', 'sk_live_', 'xoxb-', 'AIza'))}{pick(letters + '0123456789', 20, 40)} ",
            f"{key}: {word()} {word()} {word()} ",
            f"{key} = {draw.choice(('None', 'null', 'string', '${SECRET}', 'get_secret(name)', 'os.environ[name]', '<password>'))}\n",
            f"max_tokens: {draw.randint(10, 9999)}\n",
            f"{word()}://{word()}:${{{word().upper()}}}@{word()}/{word()} ",
            f"{draw.choice(('commit', 'sha256:', 'uuid ='))} {pick('0123456789abcdef', 32, 64)} {word()} ",
            f"{word()} {pick('0123456789', 16, 20)} {word()} ",
        ]
    return texts


def label_by_rules(found: DataFrame) -> DataFrame:
    """Labelled findings where reviewers' labels are missing: a value assigned to a key with a secret's name, a URL's
    password, a private key, or a value with a known prefix is a secret (1); numbers, mail and web names, placeholders,
    prose, and values after other identifiers' names are not (0). Findings that no rule covers are left out. Those of
    `example_texts` are added."""
    examples = found.sparkSession.createDataFrame([(None, text) for text in example_texts()], "doc_id long, text string")
    found = found.unionByName(find_candidates(examples))
    secrets, others = "|".join(SECRET_WORDS), "|".join(OTHER_WORDS)
    key = F.lower("before")
    assigned = key.rlike(rf"(^|[^a-z])({secrets})[a-z_\-]*[\"']?\s*(:=|=>|[=:])\s*[\"'`]?$")
    prefixed = F.col("value").rlike("^(" + "|".join(map(re.escape, SECRET_PREFIXES)) + ")") | (F.col("kind") == "prefix")
    other = key.rlike(rf"(^|[^a-z])({others})[\"']?\s*(:=|=>|[=:])?\s*[\"'`]?$")
    number = F.col("value").rlike("^[0-9_+/-]+$")
    name = F.col("after").rlike(r"^[@.][A-Za-z0-9]") | F.col("before").rlike(r"[@.:/][A-Za-z0-9.]*$") & ~assigned
    plain = ~key.rlike(rf"({secrets})") & ~key.rlike("[=:]\\s*[\"'`]?$")
    # A line of an encoded block may belong to a key whose first line is not in the text.
    plain &= ~(F.col("before").rlike("\n$") & F.col("after").rlike("^\r?\n") & F.col("value").rlike("(?=.*[a-z]).*[A-Z]"))
    keyed = F.col("kind") == "key"
    placeholder = F.col("value").rlike(f"(?s){PLACEHOLDER}")
    prose = F.col("value").rlike("^[A-Za-z][a-z]*$") & ~F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[.,;]?[ \t]+[a-z]")
    counted = number & ~key.rlike("(passw|passphrase|pwd|secret)")
    label = (
        F.when(F.col("kind") == "pem", 1.0)
        .when(F.col("kind").isin("url", "key") & placeholder, 0.0)
        .when(F.col("kind") == "url", 1.0)
        .when(keyed & (prose | counted | other), 0.0)
        .when(keyed, 1.0)
        .when(number | name | other, 0.0)
        .when(assigned | prefixed, 1.0)
        .when(plain, 0.0)
    )
    return found.withColumn("label", label).where("label is not null")


@dataclass(frozen=True)
class Tree:
    """Arrays by node: feature (-1: leaf), threshold (at most goes left), children, chance of a secret."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    chance: tuple[float, ...]


def train(labelled: DataFrame, limit: int = TRAINING_FINDINGS, trees: int = TREES, depth: int = DEPTH) -> tuple[Tree, ...]:
    """A random forest from labelled findings (`features`, `label`), fitted by Spark.

    The sample is bounded: at most about `limit` distinct findings, half of each label, chosen by a hash of value and
    neighbours, so copies count once. Without both labels the forest is one leaf with the label found (or 0).
    """
    distinct = labelled.select(
        "label", "features", F.xxhash64("value", "before", "after", "path").alias("_hash")
    ).dropDuplicates(["_hash"])
    distinct = materialize(distinct, "labelled_findings")
    counts = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    if len(counts) < 2:
        chance = float(max(counts, default=0.0))
        return (Tree((-1,), (0.0,), (-1,), (-1,), (chance,)),)
    unit = (F.col("_hash").cast("double") + 2.0**63) / 2.0**64
    shares = [F.when(F.col("label") == k, min(1.0, limit / 2 / n)) for k, n in sorted(counts.items())]
    chosen = distinct.where(unit <= F.coalesce(*shares))
    sample = chosen.select("label", array_to_vector("features").alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=0.8)
    model = forest.fit(sample)
    path = new_path(labelled.sparkSession, "forest")
    model.write().save(path)
    return read_forest(labelled.sparkSession.read.parquet(f"{path}/data"))


def read_forest(stored: DataFrame) -> tuple[Tree, ...]:
    """The saved nodes of a forest; at most 2 ** (depth + 1) of them a tree."""
    fields = {f.name for f in stored.schema}
    nodes = stored.select("treeID", "nodeData.*") if "nodeData" in fields else stored
    by_tree: dict[int, dict[int, object]] = {}
    for row in nodes.collect():
        by_tree.setdefault(row["treeID"], {})[row["id"]] = row
    trees = []
    for _, found in sorted(by_tree.items()):
        rows = [found[i] for i in range(len(found))]
        leaf = [row["leftChild"] < 0 for row in rows]
        stats = [list(row["impurityStats"]) for row in rows]
        trees.append(
            Tree(
                tuple(-1 if end else row["split"]["featureIndex"] for end, row in zip(leaf, rows, strict=True)),
                tuple(
                    0.0 if end else row["split"]["leftCategoriesOrThreshold"][0]
                    for end, row in zip(leaf, rows, strict=True)
                ),
                tuple(row["leftChild"] for row in rows),
                tuple(row["rightChild"] for row in rows),
                tuple(s[1] / sum(s) if sum(s) > 0 else 0.0 for s in stats),
            )
        )
    return tuple(trees)


def chance(trees: Sequence[Tree], values: list[float]) -> float:
    """The mean of the trees' chances."""
    total = 0.0
    for tree in trees:
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if values[tree.feature[node]] <= tree.threshold[node] else tree.right[node]
        total += tree.chance[node]
    return total / len(trees)


def scanner(trees: tuple[Tree, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _findings(batches):
            chances = [chance(trees, values) for values in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(chances, pa.float64())], names=[*batch.schema.names[:6], "chance"])

    return run


def scan(
    df: DataFrame,
    trees: tuple[Tree, ...],
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
    path_column: str | None = None,
) -> DataFrame:
    """(doc_id, start, length, value_sha256, chance, is_secret) of every candidate of every whole text.

    `start` counts characters from 0. The value itself is not returned, only its hash. `is_secret` is false for what
    the forest takes for a false positive. Null and empty texts give no rows; rows that share an id are scanned one by
    one; a text of many candidates gives as many rows; other columns are not read.
    """
    schema = "doc_id long, path string, start int, value string, before string, after string, chance double"
    found = _inputs(df, id_column, text_column, path_column).mapInArrow(scanner(trees), schema)
    return found.select(
        "doc_id",
        "start",
        F.length("value").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        F.round("chance", 6).alias("chance"),
        (F.col("chance") > threshold).alias("is_secret"),
    )


def masked(text: str | None, path: str | None, trees: Sequence[Tree], threshold: float) -> str | None:
    if not text:
        return text
    out, end = [], 0
    for found in candidates(text):
        if chance(trees, features(found, path)) > threshold:
            out += [text[end : found.start], MASK]
            end = found.start + len(found.value)
    return "".join([*out, text[end:]]) if out else text


def mask_secrets(
    df: DataFrame,
    trees: tuple[Tree, ...],
    threshold: float = THRESHOLD,
    text_column: str = "text",
    path_column: str | None = None,
) -> DataFrame:
    """`df` with every secret in its texts replaced by `[secret]`, in one pass without a shuffle; all else as it was."""
    schema = df.schema
    text_at = df.columns.index(text_column)
    path_at = df.columns.index(path_column) if path_column else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, column=text_at):
                paths = part.column(path_at).to_pylist() if path_at is not None else [None] * part.num_rows
                paths = [None if p is None else str(p) for p in paths]
                texts = part.column(text_at).to_pylist()
                clean = [masked(t, p, trees, threshold) for t, p in zip(texts, paths, strict=True)]
                columns = list(part.columns)
                columns[text_at] = pa.array(clean, type=part.schema.field(text_at).type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return df.mapInArrow(run, schema)
