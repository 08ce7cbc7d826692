"""The three end-to-end jobs: build the dataset, retrieve, and compare; each writes its tables to a folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.operators import coview, evaluation, labels, quality, rankings, retrieval
from sessiongraph.plans.chain import Chain
from sessiongraph.plans.ledger import loss_ledger
from sessiongraph.sources.tables import stack_metrics, to_long, write_artifact, write_manifest, write_model_rows


def _section(name: str, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(section, split, metric, value) of a summary; without a split column the split is `all`."""
    long = to_long(rows, keys)
    if "split" not in long.columns:
        long = long.withColumn("split", F.lit("all"))
    return long.select(F.lit(name).alias("section"), "split", "metric", "value")


def with_parameters(chain: Chain, manifest: DataFrame) -> DataFrame:
    """`manifest` and one row per parameter of the run, its value in the column `text`."""
    chosen = [(name, str(value)) for name, value in asdict(chain.settings).items()]
    rows = chain.spark.createDataFrame(chosen, "metric string, text string")
    rows = rows.select(F.lit("parameters").alias("section"), F.lit("all").alias("split"), "metric", "text")
    return manifest.unionByName(rows, allowMissingColumns=True)


def build_manifest(chain: Chain) -> DataFrame:
    """Long form (section, split, metric, value): nodes, edges, labelled pairs, production MRR."""
    features = quality.zero_vectors(chain.features).select(
        F.col("nodes").alias("num_nodes"),
        F.col("missing").alias("nodes_without_embedding"),
        F.lit(chain.settings.vector_dim).alias("embedding_dim"),
    )
    # A split whose edges are all known from train still gets its row, with a zero.
    counted = coview.held_out_edges(chain.edges).select("split", F.lit(1).alias("one")).unionByName(
        chain.edges.select("split", F.lit(0).alias("one"))
    )
    edges = counted.groupBy("split").agg(F.sum("one").alias("edges"))
    pairs = chain.pairs.groupBy("split").agg(
        F.count_if("is_positive").alias("positive"), F.count_if(~F.col("is_positive")).alias("negative")
    )
    mrr = labels.production_mrr(chain.labels).select(
        "split", F.col("mrr_matched_only").alias("matched"), F.col("mrr_coverage_adjusted").alias("coverage")
    )
    return stack_metrics(
        _section("graph", features),
        _section("co_view_edges", edges, ["split"]),
        _section("labelled_pairs", pairs, ["split"]),
        _section("production_mrr", mrr, ["split"]),
    )


def check_build(chain: Chain, max_missing_ratio: float = 1.0, expected_nodes: int | None = None) -> None:
    """Raise if the graph, the labels or the reference tables are inconsistent."""
    remapped = coview.remap_edges(chain.train_edges, chain.node_index)
    quality.require(quality.lost_endpoints(remapped), F.col("lost") == 0, "train edges lost an end")
    n_nodes = chain.node_index.agg(F.count("*")).scalar()
    quality.require(
        quality.index_range(chain.pairs, n_nodes), F.col("out_of_range") == 0, "labelled pairs outside the graph"
    )
    quality.require(
        quality.zero_vectors(chain.features),
        F.coalesce(F.col("missing_ratio"), F.lit(0.0)) <= max_missing_ratio,
        "too many nodes without a vector",
    )
    quality.require(
        quality.node_count(chain.node_index, expected_nodes), F.col("as_expected"), "unexpected number of nodes"
    )
    quality.require(
        quality.counts_match(chain.triggers.join(chain.codes, labels.EXECUTION), chain.triggers, "triggers"),
        F.col("lost") == 0,
        "triggers lost their code",
    )


def build_dataset(chain: Chain, folder: str, **checks: float | int | None) -> dict[str, str]:
    """Write graph, labels and reference rankings under `folder`; returns the path of each table."""
    check_build(chain, **checks)
    edges = coview.remap_edges(chain.train_edges, chain.node_index).select("src", "dst", "weight")
    written = {
        "session_views": write_artifact(chain.session_views, f"{folder}/session_views", "split"),
        "sessions_raw": write_artifact(
            evaluation.session_item_views(chain.session_views), f"{folder}/sessions_raw", "split"
        ),
        "edges": write_artifact(coview.held_out_edges(chain.edges), f"{folder}/edges", "split"),
        "graph_edges": write_artifact(coview.symmetric_edges(edges), f"{folder}/graph_edges"),
        "node_index": write_artifact(chain.node_index, f"{folder}/node_index"),
        "execution_codes": write_artifact(chain.codes, f"{folder}/execution_codes", "split"),
        "node_features": write_artifact(chain.features, f"{folder}/node_features"),
        "labelled_pairs": write_artifact(chain.pairs, f"{folder}/labelled_pairs", "split"),
        "owners": write_artifact(chain.owners, f"{folder}/owners", "split"),
        "prod_results": write_artifact(chain.prod, f"{folder}/prod_results", "split"),
    }
    written["loss_ledger"] = write_manifest(loss_ledger(chain), f"{folder}/loss_ledger")
    written["manifest"] = write_manifest(with_parameters(chain, build_manifest(chain)), f"{folder}/manifest")
    return written


def retrieve(chain: Chain, folder: str) -> dict[str, str]:
    """Write the model's ranking of every graph trigger, its checks and counters under `folder`.

    An exact ranking is checked against an independent dot product for all triggers. With `approximate`
    set, the exact one is built and checked only for `compare_with_exact` or `min_recall`; the approximate
    one is then measured against it and refused under `min_recall`.
    """
    chosen, triggers = chain.settings, chain.graph_triggers
    sections = []
    if not chosen.approximate or chosen.compare_with_exact or chosen.min_recall is not None:
        parity = retrieval.check_against_pairwise(
            chain.exact_rows, triggers, chain.pool, chain.vectors, chosen.top_k, chosen.parity_tolerance
        )
        quality.require(parity, F.col("mismatches") == 0, "retrieval differs from the dot product")
        sections.append(_section("parity", parity))
        if chosen.approximate:
            recall = retrieval.recall_against_exact(triggers, chain.approximate_rows, chain.exact_rows)
            if chosen.min_recall is not None:
                quality.require(recall, F.col("mean_recall") >= chosen.min_recall, "approximate recall too low")
            sections.append(_section("recall", recall))
    written = {
        "model_rows": write_model_rows(chain.model_rows, f"{folder}/model_rows"),
        "model_results": write_artifact(chain.model, f"{folder}/model_results", "split"),
    }
    counters = retrieval.retrieval_counters(chain.owners, triggers, chain.model_rows)
    sections.append(_section("triggers", counters, ["split"]))
    sections.append(_section("model_mrr", rankings.list_mrr(chain.model, "positives"), ["split"]))
    written["retrieval_manifest"] = write_manifest(
        with_parameters(chain, stack_metrics(*sections)), f"{folder}/retrieval_manifest"
    )
    return written


REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "population": evaluation.population,
    "arm_summary": evaluation.arm_summary,
    "case_matrix": evaluation.case_matrix,
    "list_overlap": evaluation.list_overlap,
    "by_session_type": evaluation.by_session_type,
    "variant_crossing": evaluation.variant_crossing,
    "matrices_by_session": evaluation.matrices_by_session,
}


def statistics(chain: Chain, folder: str) -> dict[str, str]:
    """Compare the three arms: metadata, per-trigger metrics, and one small table per report."""
    quality.require(
        quality.alignment(chain.prod, chain.model), F.col("mismatched") == 0, "codes name different triggers"
    )
    written = {
        "product_metadata": write_artifact(chain.metadata, f"{folder}/product_metadata"),
        "trigger_metrics": write_artifact(chain.metrics, f"{folder}/trigger_metrics", "split"),
    }
    metrics = chain.spark.read.parquet(written["trigger_metrics"])
    quality.require(
        quality.impossible_cells(evaluation.matrices_by_session(metrics)),
        F.col("cells") == 0,
        "a matrix cell that must be zero is not",
    )
    for name, report in REPORTS.items():
        written[name] = write_manifest(report(metrics), f"{folder}/{name}")
    rollup = evaluation.session_rollup(metrics)
    written["session_level"] = write_manifest(evaluation.session_level(rollup), f"{folder}/session_level")
    written["session_crossing"] = write_manifest(evaluation.session_crossing(rollup), f"{folder}/session_crossing")
    return written


def run_all(chain: Chain, folder: str) -> dict[str, str]:
    """All three jobs; later ones add their paths to those of the earlier ones."""
    parts = [build_dataset(chain, folder), retrieve(chain, folder), statistics(chain, folder)]
    return reduce(lambda a, b: {**a, **b}, parts, {})
