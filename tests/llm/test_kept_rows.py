"""Filtering stages judge rows, not ids: nothing clean goes with a row of the same id, and of equal rows one stays."""

from __future__ import annotations

import random

from sessiongraph.llm import decontamination, language_id, near_duplicates

ROWS = "doc_id long, text string, lang string, _row int, class_id string"
WORDS = {"en": "the of and house river walking under seven".split(), "fr": "le des maison rivière sous sept avec trois".split()}


def prose(lang: str, seed: int, n: int = 60) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS[lang]) + draw.choice("aeiou") for _ in range(n))


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "c") for i, t in rows], ROWS)


def test_near_duplicates_keep_one_row_of_each_class(spark):
    copied, other = prose("en", 1), prose("en", 2)
    rows = [(1, copied), (1, copied), (2, copied), (3, other), (3, copied), (None, copied), (None, None), (4, ""), (4, "")]
    found = near_duplicates.keep_one(table(spark, rows).repartition(3))
    assert kept(found) == sorted([(1, copied), (3, other), (None, None), (4, ""), (4, "")], key=str)
    assert found.columns == ["doc_id", "text", "lang", "_row", "class_id"]
    assert near_duplicates.keep_one(table(spark, [])).count() == 0


def test_language_and_benchmark_judge_rows(spark):
    english = [(i, prose("en", i)) for i in range(20)]
    model = language_id.train(table(spark, english))
    junk, clean = "zq" * 400, prose("en", 50)
    rows = [(1, junk), (1, clean), (None, junk), (None, clean), (2, clean), (2, clean), (3, None), (4, "12 34")]
    found = language_id.reject(table(spark, rows), model)
    assert kept(found) == sorted([(1, clean), (None, clean), (2, clean), (2, clean)], key=str)
    assert language_id.reject(table(spark, []), model).count() == 0

    item = prose("fr", 9)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"{clean} {item}"), (1, clean), (None, item), (None, clean), (2, None), (3, ""), (5, clean), (5, clean)]
    found = decontamination.without_contaminated(table(spark, rows), items)
    assert kept(found) == sorted([(1, clean), (None, clean), (2, None), (3, ""), (5, clean), (5, clean)], key=str)
    assert decontamination.without_contaminated(table(spark, []), items).count() == 0
