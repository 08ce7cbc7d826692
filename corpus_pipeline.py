"""A training-data pipeline over `documents`: STAGES in order, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessiongraph.llm import decontamination, language_id, near_duplicates, secrets, sentence_pieces
from sessiongraph.llm.queries import piece_model, table
from sessiongraph.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# No stage's rows can be had in SQL as a whole (suffix automata, forests, pieces); the tests compare with brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled rows show."""
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.reject(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return near_duplicates.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; the forest learns from findings of the same documents."""
    found = secrets.find_candidates(docs, path_column="source")
    forest = secrets.train(secrets.label_by_rules(found))
    return secrets.mask_secrets(docs, forest, path_column="source")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and the decoded texts."""
    return sentence_pieces.encode_documents(docs, piece_model())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("sentence_pieces", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {}
