"""License scan: MinHash retrieval of license notices, verified by shingle containment. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongraph.session import materialize

SHINGLE = 3
WINDOW = 8
STRIDE = 2
CONTAINMENT = 0.8
# Chance that a window with a whole notice of the fewest shingles shares no band with it.
MISSED = 1e-5

# Public license notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without permission."),
)

# Everything but ASCII letters and digits and other scripts' characters separates words.
SEPARATORS = "[^a-z0-9\\u0080-\\uffff]+"


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), SEPARATORS)


def shingles_of(words: Column, width: int = SHINGLE) -> Column:
    """An array with one entry: the hashes of all runs of `width` words, empty for fewer words.

    The words are bound to a lambda variable. Written out inside the inner lambda they would be split anew for
    every run, and Spark's optimizer puts a plain column back there.
    """

    def runs(bound: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(bound, i + k) for k in range(width)])
        hashes = F.transform(F.sequence(F.lit(0), F.size(bound) - width), run)
        return F.when(F.size(bound) >= width, hashes).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), runs)


def windows_of(shingles: Column, length: int, stride: int) -> Column:
    """Overlapping runs of `length` shingles; the last one may be shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(shingles) - length + stride, F.lit(1)), F.lit(stride))
    return F.transform(starts, lambda start: F.slice(shingles, start, length))


def band_count(least: int, length: int, missed: float = MISSED) -> int:
    """Bands of one MinHash each: a notice of `least` shingles inside a window of `length` has a Jaccard similarity
    of at least least / length, so all bands differ with a chance of (1 - least / length) ** bands."""
    return 1 if least >= length else math.ceil(math.log(missed) / math.log(1 - least / length))


def band_keys(window: Column, bands: int) -> Column:
    """One key per band: the band's number and the smallest shingle under the band's own order."""
    return F.array(
        *[
            F.xxhash64(F.lit(band), F.array_min(F.transform(window, lambda s: F.xxhash64(s, F.lit(band)))))
            for band in range(bands)
        ]
    )


def notice_table(spark: SparkSession, notices=NOTICES) -> DataFrame:
    rows = [(number, name, text) for number, (name, text) in enumerate(notices)]
    return spark.createDataFrame(rows, "notice int, license string, notice_text string")


def scan(
    df: DataFrame,
    notices: DataFrame | None = None,
    containment: float = CONTAINMENT,
    window: int = WINDOW,
    stride: int = STRIDE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, license, notice, matched, n_shingles) of all notices found in a document.

    A notice is found if the document holds at least `containment` of its distinct runs of three words, wherever its
    lines were broken or how it was punctuated. Windows of `window` words retrieve notices by MinHash bands, notices
    cut into windows of the same length; full sets of shingles then decide. Documents without any shingle of any notice
    cannot pass and are left out before the windows are made.

    The notices' band keys are a few hundred rows and are broadcast; their size is checked. Null, empty and short texts
    give no rows; rows that share an id are scanned one by one; extra columns are not read.
    """
    spark = df.sparkSession
    notices = notice_table(spark) if notices is None else notices
    length = window - SHINGLE + 1
    ordered = notices.select("notice", "license", F.explode(shingles_of(words_of(F.col("notice_text")))).alias("_run"))
    ordered = materialize(ordered, "notices")
    known = ordered.select("notice", "license", F.array_distinct("_run").alias("_set"))
    known = known.where(F.size("_set") > 0)
    bounds = known.agg(F.min(F.size("_set")).alias("least"), F.sum(F.size("_set")).alias("total")).first()
    schema = "doc_id long, license string, notice int, matched int, n_shingles int"
    if bounds["total"] is None:
        return spark.createDataFrame([], schema)
    bands = band_count(math.ceil(bounds["least"] * containment), length)

    vocabulary = known.select(F.explode("_set").alias("_shingle")).distinct()
    small = bounds["total"] * (bands + 1) <= 1_000_000
    hint = F.broadcast if small else (lambda table: table)
    runs = shingles_of(words_of(F.col(text_column)))
    if small:
        literal = F.array(*[F.lit(row[0]) for row in vocabulary.collect()])
        runs = F.filter(runs, lambda hashes: F.arrays_overlap(hashes, literal))
    documents = df.where(F.length(text_column) > 0)
    documents = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.explode(runs).alias("_shingles"))
    documents = materialize(documents.withColumn("_row", F.monotonically_increasing_id()), "notice_documents")

    notice_keys = ordered.select("notice", F.explode(windows_of(F.col("_run"), length, 1)).alias("_window"))
    notice_keys = notice_keys.where(F.size("_window") > 0)
    notice_keys = notice_keys.select("notice", F.explode(band_keys(F.col("_window"), bands)).alias("_key")).distinct()
    windows = documents.select("_row", F.explode(windows_of(F.col("_shingles"), length, stride)).alias("_window"))
    windows = windows.select("_row", F.explode(band_keys(F.col("_window"), bands)).alias("_key"))
    retrieved = windows.join(hint(notice_keys), "_key").select("_row", "notice").distinct()

    verified = retrieved.join(documents, "_row").join(hint(known), "notice")
    matched = F.size(F.array_intersect("_set", "_shingles"))
    return verified.select("doc_id", "license", "notice", matched.alias("matched"), F.size("_set").alias("n_shingles")).where(
        F.col("matched") >= F.col("n_shingles") * containment - 1e-9
    )
