"""Self join of documents on the Jaccard similarity of their word n-grams."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.llm.common import grams, lowered, mix, separator_table, slices, text_pass, word_hashes
from sessiongraph.llm.components import components
from sessiongraph.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NGRAM = 5
SIMILARITY = 0.8
# Share of the pairs at exactly the threshold that share no band; pairs above it miss less often.
MISSED = 1e-4
MAX_HASHES = 128
# Shingles of one block of documents: bounds the memory of a verification task (about 8 bytes each, twice).
BLOCK_SHINGLES = 200_000
COLUMNS = 4096


def banding(similarity: float, missed: float = MISSED, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band for which `max_hashes` suffice to miss at most `missed` of the
    pairs at the threshold: bands = ln(missed) / ln(1 - similarity ** rows)."""
    best = (math.ceil(math.log(missed) / math.log(1 - similarity)), 1) if similarity < 1 else (1, 1)
    for rows in range(2, max_hashes + 1):
        bands = 1 if similarity >= 1 else math.ceil(math.log(missed) / math.log1p(-(similarity**rows)))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def shingle_sets(texts: list[str | None], width: int, separators: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text of fewer words has one n-gram of all its words."""
    out = []
    for _, part in slices(map(lowered, texts)):
        hashes, offsets = word_hashes(part, separators)
        for start, stop in zip(offsets[:-1], offsets[1:], strict=True):
            words = hashes[start:stop]
            out.append(np.unique(grams(words, min(width, len(words)))) if len(words) else words)
    return out


def sketcher(bands: int, rows: int, width: int) -> Callable[[list, list], dict]:
    """The batch function of the sketch pass: n-gram count, key of the n-gram set, one hash per band."""
    separators = separator_table()
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    band_seeds = mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(20))

    def sketch(ids: list, texts: list) -> dict:
        sets = shingle_sets(texts, width, separators)
        counts = [len(s) for s in sets]
        full = [i for i, n in enumerate(counts) if n]
        keys: list[bytes | None] = [None] * len(ids)
        lists: list[np.ndarray | None] = [None] * len(ids)
        if full:
            values = np.concatenate([sets[i] for i in full])
            first = np.concatenate(([0], np.cumsum([counts[i] for i in full])[:-1])).astype(np.int64)
            least = np.empty((bands * rows, len(full)), dtype=np.uint64)
            for k, seed in enumerate(seeds):
                least[k] = np.minimum.reduceat((values ^ seed) * (seed | np.uint64(1)), first)
            joined = np.zeros((bands, len(full)), dtype=np.uint64)
            for r in range(rows):
                joined = mix(joined * np.uint64(31) + least[r::rows])
            joined = mix(joined ^ band_seeds[:, None]).astype(np.int64)
            # Two independent sums over the set tell different sets apart.
            total = np.add.reduceat(mix(values), first)
            other = np.add.reduceat(mix(values ^ seeds[0]), first)
            for column, i in enumerate(full):
                keys[i] = total[column].tobytes() + other[column].tobytes() + counts[i].to_bytes(8, "little")
                lists[i] = joined[:, column]
        return {"doc_id": ids, "n_shingles": counts, "set_key": keys, "bands": lists}

    return sketch


def set_packer(width: int) -> Callable[[list, list], dict]:
    separators = separator_table()

    def pack(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "shingles": [s.tobytes() for s in shingle_sets(texts, width, separators)]}

    return pack


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left and right sets, by products of 0/1 column blocks.

    Columns are the n-grams that occur on both sides; the others cannot count.
    """
    sizes = np.zeros((len(left), len(right)), dtype=np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    places = []
    for side in (left, right):
        values = np.concatenate(side)
        owner = np.repeat(np.arange(len(side)), [len(s) for s in side])
        column = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        kept = shared[column] == values if len(shared) else np.zeros(len(values), dtype=bool)
        order = np.argsort(column[kept], kind="stable")
        places.append((owner[kept][order], column[kept][order]))
    for start in range(0, len(shared), COLUMNS):
        blocks = []
        for (owner, column), side in zip(places, (left, right), strict=True):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            block = np.zeros((len(side), COLUMNS), dtype=np.float32)
            block[owner[a:b], column[a:b] - start] = 1
            blocks.append(block)
        sizes += blocks[0] @ blocks[1].T
    return sizes


def verifier(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """The group function of one pair of blocks: links of each document, and a spanning forest of the links."""

    def verify(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        blocks = table["block"].to_numpy()
        ids = table["doc_id"].to_numpy()
        copies = table["copies"].to_numpy()
        raw = table["shingles"].to_pylist()
        sides = []
        for block in (low, high):
            _, rows = np.unique(np.where(blocks == block, ids, np.iinfo(np.int64).max), return_index=True)
            rows = rows[blocks[rows] == block]
            sides.append((rows, [np.frombuffer(raw[i], dtype=np.uint64) for i in rows]))
        (rows_a, sets_a), (rows_b, sets_b) = sides
        out_ids: list[int] = []
        out_links: list[int] = []
        out_others: list[int | None] = []
        if sets_a and sets_b:
            common = intersections(sets_a, sets_b).astype(np.float64)
            size_a = np.array([len(s) for s in sets_a])[:, None]
            size_b = np.array([len(s) for s in sets_b])[None, :]
            # Compared without a division: |A and B| >= s * |A or B|.
            linked = common >= similarity * (size_a + size_b - common) - 1e-9
            if low == high:
                np.fill_diagonal(linked, False)
            gained = [(rows_a, linked @ copies[rows_b])]
            if low != high:
                gained.append((rows_b, linked.T @ copies[rows_a]))
            for rows, links in gained:
                some = links > 0
                out_ids += ids[rows[some]].tolist()
                out_links += links[some].astype(int).tolist()
                out_others += [None] * int(some.sum())
            for a, b in forest(linked):
                out_ids.append(int(ids[rows_a[a]]))
                out_links.append(0)
                out_others.append(int(ids[rows_b[b]]))
        return pa.table(
            {
                "doc_id": pa.array(out_ids, type=pa.int64()),
                "links": pa.array(out_links, type=pa.int64()),
                "other": pa.array(out_others, type=pa.int64()),
            }
        )

    return verify


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) of a spanning forest of the bipartite graph `linked`, breadth first."""
    out: list[tuple[int, int]] = []
    free_rows = np.ones(linked.shape[0], dtype=bool)
    free_columns = np.ones(linked.shape[1], dtype=bool)
    for first in range(linked.shape[0]):
        if not free_rows[first]:
            continue
        free_rows[first] = False
        rows = [first]
        while rows:
            columns: list[int] = []
            for a in rows:
                found = np.flatnonzero(linked[a] & free_columns)
                free_columns[found] = False
                columns += found.tolist()
                out += [(a, b) for b in found.tolist()]
            rows = []
            for b in columns:
                found = np.flatnonzero(linked[:, b] & free_rows)
                free_rows[found] = False
                rows += found.tolist()
                out += [(a, b) for a in found.tolist()]
    return out


def candidate_clusters(sketches: DataFrame) -> DataFrame:
    """(doc_id, cluster) of all representatives that share a band with another one, directly or in a chain.

    Each band value links its members to their smallest one, so a band of m members gives m - 1 links.
    """
    banded = sketches.select("doc_id", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"))
    hubs = hubs.where(F.col("hub") != F.col("last")).select("band", "hub")
    links = banded.join(hubs, "band").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    return components(links).select(F.col("id").alias("doc_id"), F.col("root").alias("cluster"))


def near_duplicates(
    df: DataFrame,
    similarity: float = SIMILARITY,
    width: int = NGRAM,
    missed: float = MISSED,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, rep_id, copies, n_links.

    Documents are linked if the Jaccard similarity of their sets of `width`-word n-grams is `similarity` or
    more. Words are runs without ASCII white space in the lower-cased text; a text of fewer words has one n-gram
    of all of them. `class_id` is the smallest id connected by links, `n_links` the number of other documents
    linked directly, `rep_id` the smallest id and `copies` the number of documents with the same n-gram set.

    1. A pass over the texts makes sketches: set key, MinHash values joined to bands (see `banding`).
    2. Equal sets are one representative from here on, however many copies there are.
    3. Band values are shuffled; members link to the smallest one. Connected members form a cluster.
    4. A cluster is hashed into blocks of about `block_shingles` n-grams; each pair of blocks is one task that
       compares full n-gram sets and returns link counts and a spanning forest, never all pairs.
    5. The forests are connected into classes.

    Documents without words (null, empty, blank) are in classes of their own without links. Rows with a null id
    come back with null class and no links. Rows that share an id count as copies if their texts agree; ids
    should otherwise be unique. Extra columns are not read.
    """
    bands, rows = banding(similarity, missed)
    schema = "doc_id long, n_shingles int, set_key binary, bands array<long>"
    sketches = materialize(text_pass(df, sketcher(bands, rows, width), schema, id_column, text_column), "sketches")
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    sets = usable.groupBy("set_key").agg(
        F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("_n")
    )
    sets = materialize(sets, "sets")
    representatives = usable.join(sets, (usable.set_key == sets.set_key) & (usable.doc_id == sets.rep_id), "left_semi")
    clusters = materialize(candidate_clusters(representatives.select("doc_id", "bands")), "clusters")

    members = clusters.join(sets, clusters.doc_id == sets.rep_id).select("doc_id", "cluster", "copies", "_n")
    sizes = members.groupBy("cluster").agg(F.sum("_n").alias("_total"))
    sizes = sizes.select("cluster", F.ceil(F.col("_total") / block_shingles).cast("int").alias("_blocks"))
    members = materialize(
        members.join(sizes, "cluster").select(
            "doc_id",
            "cluster",
            "copies",
            "_blocks",
            F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int").alias("block"),
        ),
        "members",
    )
    texts = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    texts = texts.join(members.select("doc_id"), "doc_id", "left_semi")
    packed = text_pass(texts, set_packer(width), "doc_id long, shingles binary", "doc_id", "text")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    placed = packed.join(members, "doc_id").withColumn("_other", other)
    placed = placed.select(
        "doc_id",
        "copies",
        "shingles",
        "cluster",
        "block",
        F.least("block", "_other").alias("low"),
        F.greatest("block", "_other").alias("high"),
    )
    found = materialize(
        placed.groupBy("cluster", "low", "high").applyInArrow(
            verifier(similarity), "doc_id long, links long, other long"
        ),
        "links",
    )
    links = found.groupBy("doc_id").agg(F.sum("links").alias("_links")).withColumnRenamed("doc_id", "rep_id")
    classes = components(found.where("other is not null").select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
    classes = classes.select(F.col("id").alias("rep_id"), "root")
    by_set = sets.join(links, "rep_id", "left").join(classes, "rep_id", "left")
    by_set = by_set.select(
        "set_key",
        "rep_id",
        "copies",
        F.coalesce("root", "rep_id").alias("_class"),
        (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_all_links"),
    )
    known = F.col("doc_id").isNotNull()
    return (
        sketches.select("doc_id", "n_shingles", "set_key")
        .join(by_set, "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(known, F.coalesce("_class", "doc_id")).alias("class_id"),
            F.when(known, F.coalesce("rep_id", "doc_id")).alias("rep_id"),
            F.when(known, F.coalesce("copies", F.lit(1))).alias("copies"),
            F.when(known, F.coalesce("_all_links", F.lit(0))).otherwise(0).alias("n_links"),
        )
    )


def keep_one(df: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest id, a null id last.

    Rows are numbered and stored first, and classes are those of rows: rows that share an id are told apart, and of
    equal rows one stays. Rows without words are in classes of their own and stay.
    """
    number = "_".join(["_row", *df.columns])
    rows = materialize(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    classes = near_duplicates(rows, id_column=number, **options).select(F.col("doc_id").alias(number), "class_id")
    ids = rows.select(number, F.col(id_column).alias("_id"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", number))
    kept = classes.join(ids, number).groupBy("class_id").agg(first.alias("first")).select(F.col(f"first.{number}"))
    return rows.join(kept, number, "left_semi").select(*df.columns)
