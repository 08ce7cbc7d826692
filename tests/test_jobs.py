from __future__ import annotations

import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sessiongraph.operators import quality
from sessiongraph.plans import jobs
from sessiongraph.plans.chain import Chain
from sessiongraph.plans.registry import run_of
from sessiongraph.sources import entities, tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")
def test_all_jobs(spark, tmp_path):
    run = run_of(spark, SF_DIR)
    paths = jobs.run_all(run, str(tmp_path))
    sections = {r[0] for r in rows(spark.read.json(paths["manifest"]), "section")}
    assert sections == {"graph", "co_view_edges", "labelled_pairs", "production_mrr", "parameters"}
    sections = {r[0] for r in rows(spark.read.json(paths["retrieval_manifest"]), "section")}
    assert sections == {"parity", "triggers", "model_mrr", "parameters"}
    metrics = spark.read.parquet(paths["trigger_metrics"])
    prod = spark.read.parquet(paths["prod_results"])
    assert metrics.count() == prod.count() == run.codes.count()
    case = spark.read.json(paths["case_matrix"])
    answered = metrics.where("model_answered").count()
    assert {r[0] for r in rows(case.groupBy("arm").agg(F.sum("count").alias("n")), "n")} == {answered}
    pairs = spark.read.parquet(paths["labelled_pairs"])
    both = pairs.groupBy("split", "exec_code", "src", "dst").agg(F.count_distinct("is_positive").alias("n"))
    assert both.where("n > 1").count() == 0
    with pytest.raises(ValueError, match="number of nodes"):
        jobs.check_build(run, expected_nodes=1)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")
def test_approximate_job(spark, tmp_path):
    exact = run_of(spark, SF_DIR)
    chosen = replace(
        exact.settings, approximate=True, min_recall=0.9, ranking_splits=("val",)
    )
    run = Chain(exact.inputs, chosen)
    paths = jobs.retrieve(run, str(tmp_path))
    manifest = spark.read.json(paths["retrieval_manifest"])
    assert rows(manifest.where("metric = 'mean_recall'"), "value")[0][0] >= 0.9
    assert rows(spark.read.parquet(paths["model_results"]).select("split").distinct()) == [("val",)]
    plain = Chain(exact.inputs, replace(chosen, min_recall=None))
    paths = jobs.retrieve(plain, str(tmp_path / "plain"))
    assert "exact_rows" not in vars(plain) and "approximate_rows" in vars(plain)
    sections = {r[0] for r in rows(spark.read.json(paths["retrieval_manifest"]), "section")}
    assert sections == {"triggers", "model_mrr", "parameters"}
    with pytest.raises(ValueError, match="approximate"):
        replace(exact.settings, min_recall=0.5)


def test_empty_model_rows_stay_readable(spark, tmp_path):
    empty = spark.createDataFrame([], tables.MODEL_ROWS)
    path = tables.write_model_rows(empty, str(tmp_path / "rows"))
    assert tables.read_artifact(spark, path).schema == tables.MODEL_ROWS


def test_latest_vector_wins(spark):
    data = [
        ("1", [1.0], "old", "a", 9), ("1", [2.0], "cur", "b", 1), ("1", [3.0], "cur", "c", 2), ("x", [4.0], "cur", "d", 1),
    ]
    df = spark.createDataFrame(data, "item_id string, vector array<float>, model_id string, category string, updated_at int")
    found = entities.current_vectors(df, "cur")
    assert rows(found, "item_id", "category") == [(None, "d"), (1, "c")]


def test_reports(spark):
    report = quality.conflicting_values(spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "k long, v long"), ["k"], "v")
    assert rows(report) == [(2, 1)]
    with pytest.raises(ValueError, match="conflicts"):
        quality.require(report, F.col("conflicts") == 0, "conflicts")
    quality.require(report, F.col("keys") == 2, "keys")
    found = spark.createDataFrame([(1, "a")], "x long, y string")
    expected = spark.createDataFrame([(1, 2)], "x long, y long").schema
    assert quality.schema_drift(found, expected) == [("y", "bigint", "string")]
    zero = spark.createDataFrame([([0.0, 0.0],), ([0.0, 1.0],)], "vector array<double>")
    assert rows(quality.zero_vectors(zero)) == [(2, 1, 0.5)]


def test_intermediate_tables_can_be_dropped(tmp_path):
    code = f"""
from pathlib import Path
from sessiongraph.session import build_session, drop_tables, materialize
spark = build_session("drop", "local[1]", spark__checkpoint__dir={str(tmp_path)!r}, spark__ui__enabled="false")
assert materialize(spark.range(3)).count() == 3
assert list(Path({str(tmp_path)!r}).rglob("*.parquet"))
drop_tables(spark)
drop_tables(spark)
assert not list(Path({str(tmp_path)!r}).rglob("*.parquet"))
"""
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
