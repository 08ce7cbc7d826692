"""Registered queries: a Spark function each, with the SQL that must give the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongraph.operators import coview, index, review
from sessiongraph.plans.chain import Chain, Inputs, Settings
from sessiongraph.plans.oracle_views import with_views
from sessiongraph.session import materialize, partitions_for, passing_table, shuffle_partitions
from sessiongraph.sources import entities, fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Doubles are compared at this many decimals: sums depend on their order in the last bits.
DECIMALS = 6

_runs: dict[tuple[str, str], Run] = {}


class Run(Chain):
    """A chain over one folder of the driver's tables, with the inputs queries also use directly."""

    def __init__(self, spark: SparkSession, location: str) -> None:
        self.location = location
        super().__init__(
            Inputs(
                fixtures.view_events(spark, location),
                fixtures.identity_map(spark, location),
                fixtures.recommendation_logs(spark, location),
                fixtures.catalog(spark, location),
                fixtures.item_vectors(spark, location),
            ),
            Settings(
                fixtures.CUTOFF_TRAIN,
                fixtures.CUTOFF_VAL,
                fixtures.MODEL_ID,
                fixtures.VECTOR_DIM,
                session_timeout=fixtures.SESSION_TIMEOUT,
                top_k=fixtures.TOP_K,
                catalog_items_only=False,
            ),
        )
        self.view_events = self.inputs.view_events
        self.identity = self.inputs.identity
        self.catalog = self.inputs.catalog

    @cached_property
    def logs(self) -> DataFrame:
        """The nested log as a stored table, as it would arrive; the click events come in one file."""
        rows = self.inputs.logs.repartition(shuffle_partitions(self.spark), "execution_id")
        return materialize(rows, "logs")

    @cached_property
    def accounts(self) -> DataFrame:
        return entities.resolve_account(
            fixtures.accounts(self.spark, self.location),
            fixtures.insights_accounts(self.spark, self.location),
            fixtures.publishers(self.spark, self.location),
        )

    @cached_property
    def scores(self) -> DataFrame:
        return fixtures.scored_pairs(self.spark, self.location)

    @cached_property
    def classes(self) -> DataFrame:
        return fixtures.class_scores(self.spark, self.location)

    @cached_property
    def baskets(self) -> DataFrame:
        return materialize(fixtures.baskets(self.spark, self.location), "baskets", lean=True)

    @cached_property
    def basket_nodes(self) -> DataFrame:
        return materialize(index.dense_index(self.baskets, "item_id", "node_idx"), "basket_nodes", lean=True)

    @cached_property
    def basket_features(self) -> DataFrame:
        """(node_idx, vector): how many lines of each item were shipped in each month of the year."""
        months = fixtures.shipped_months(self.spark, self.location)
        per_month = [F.count_if(F.col("month") == m).cast("double") for m in range(1, 13)]
        counts = months.groupBy("item_id").agg(F.array(*per_month).alias("vector"))
        return materialize(counts.join(self.basket_nodes, "item_id").select("node_idx", "vector"), "basket_features", lean=True)

    @cached_property
    def basket_edges(self) -> DataFrame:
        """Train edges of the baskets by node index: the large graph of the folder."""
        nodes = self.basket_nodes
        with passing_table(coview.edges_of(coview.co_view_edges(self.baskets), "train"), "basket_train_edges") as train:
            parts = partitions_for(self.spark, train.count())
            indexed = coview.remap_edges(train, nodes, parts)
            return materialize(indexed.select("src", "dst", "weight"), "basket_edges", lean=True)

    @cached_property
    def sample(self) -> DataFrame:
        return materialize(review.display_sample(self.owners, self.prod), "sample")


def run_of(spark: SparkSession, location: str) -> Run:
    """The run over a folder; its staged tables are written once per application and folder."""
    key = (spark.sparkContext.applicationId, location)
    if key not in _runs:
        _runs[key] = Run(spark, location)
    return _runs[key]


def forget_runs() -> None:
    """Drop all staged tables, so that the next query builds its own."""
    _runs.clear()


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(f.name, DECIMALS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema
        ]
    )


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Run], DataFrame]], Callable]:
    """Register a function of a run under `name`."""

    def register(build: Callable[[Run], DataFrame]) -> Callable[[Run], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(run_of(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register
