"""The tables of one run as lazy DataFrames, each built from the ones before it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.operators import coview, evaluation, index, inverted_lists, labels, rankings, retrieval, sessions
from sessiongraph.session import materialize
from sessiongraph.sources import behavior, entities


@dataclass(frozen=True)
class Inputs:
    """The tables a run starts from.

    view_events: account_id, emitted, item_id, user_id, cookie
    identity: source_id, master_id
    logs: execution_id, log_instant, account_id, publisher_id, cookie, item_id, page_type,
        placements array<struct<candidates: array<struct<item_id, score>>>>
    catalog: item_id, db_name, is_active, is_in_stream, parent_id, name, image_url
    vectors: item_id, vector, category, model_id, db_name, updated_at
    accounts: account_id, db_name, publisher_id, or None to take every account
    """

    view_events: DataFrame
    identity: DataFrame
    logs: DataFrame
    catalog: DataFrame
    vectors: DataFrame
    accounts: DataFrame | None = None


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; dates are ISO strings."""

    cutoff_train: str
    cutoff_val: str
    model_id: str
    vector_dim: int
    start: str | None = None
    end: str | None = None
    session_timeout: int = sessions.DEFAULT_TIMEOUT
    top_k: int = labels.DEFAULT_DEPTH
    catalog_items_only: bool = True
    normalize_weights: bool = False
    exclude_trigger: bool = False
    after_log_only: bool = False
    pure_negative_fraction: float = 0.0
    seed: int = 42
    ranking_splits: tuple[str, ...] = ("train", "val", "test")
    approximate: bool = False
    probes: int | None = None
    list_recall: float = inverted_lists.DEFAULT_RECALL
    bounded: bool = False
    min_recall: float | None = None
    compare_with_exact: bool = False
    parity_tolerance: float = 1e-5

    def __post_init__(self) -> None:
        if self.min_recall is not None and not self.approximate:
            raise ValueError("min_recall needs approximate=True: an exact ranking has nothing to be measured against")


def staged(build):
    """A lazily built attribute whose table is written once and read back."""

    def attribute(self: Chain) -> DataFrame:
        return materialize(build(self), build.__name__)

    prop = cached_property(attribute)
    prop.__doc__ = build.__doc__
    return prop


class Chain:
    """Behavior, graph, labels, rankings, retrieval and evaluation of one run.

    Tables that several later steps read are written to the shared folder once per object (`staged`);
    the others stay lazy.
    """

    def __init__(self, inputs: Inputs, settings: Settings) -> None:
        self.inputs = inputs
        self.settings = settings
        self.spark = inputs.view_events.sparkSession

    def stage_all(self) -> dict[str, DataFrame]:
        """Build and store every table of the run; returns them by name."""
        names = [
            "session_views", "edges", "node_index", "matched", "triggers", "codes", "labels", "negatives",
            "pairs", "owners", "prod", "vectors", "features", "graph_triggers", "pool", "model_rows", "model",
            "metrics", "metadata",
        ]
        return {name: getattr(self, name) for name in names}

    @cached_property
    def logs(self) -> DataFrame:
        return labels.without_trigger(self.inputs.logs) if self.settings.exclude_trigger else self.inputs.logs

    @cached_property
    def views(self) -> DataFrame:
        given, chosen = self.inputs, self.settings
        views = behavior.resolve_views(
            given.view_events, given.identity, given.accounts, chosen.start, chosen.end
        )
        if not chosen.catalog_items_only:
            return views
        return behavior.keep_catalog_items(views, entities.active_master_items(given.catalog, given.accounts))

    @cached_property
    def session_views(self) -> DataFrame:
        """Stored by `sessionize`; what is left to do is cheap for each reader."""
        cut = sessions.sessionize(self.views, self.settings.session_timeout)
        return sessions.split_by_time(cut, self.settings.cutoff_train, self.settings.cutoff_val)

    @cached_property
    def items(self) -> DataFrame:
        return coview.session_items(self.session_views)

    @staged
    def listed(self) -> DataFrame:
        return rankings.listed_sessions(self.items)

    @staged
    def edges(self) -> DataFrame:
        return coview.co_view_edges(self.session_views, self.settings.normalize_weights)

    @cached_property
    def train_edges(self) -> DataFrame:
        return coview.edges_of(self.edges, "train")

    @staged
    def node_index(self) -> DataFrame:
        return index.dense_index(coview.graph_nodes(self.edges), "item_id", "node_idx")

    @staged
    def matched(self) -> DataFrame:
        given, chosen = self.inputs, self.settings
        pairs = behavior.match_logs_to_views(
            self.logs,
            given.view_events,
            given.identity,
            given.accounts,
            given.accounts,
            chosen.start,
            chosen.end,
        )
        return behavior.attach_sessions(pairs, self.session_views)

    @staged
    def triggers(self) -> DataFrame:
        return labels.distinct_triggers(self.matched)

    @staged
    def codes(self) -> DataFrame:
        return labels.execution_codes(self.triggers)

    @staged
    def labels(self) -> DataFrame:
        late = self.settings.after_log_only
        seen = coview.last_views(self.session_views) if late else self.items
        return labels.label_candidates(self.triggers, self.logs, seen, self.settings.top_k, late)

    @cached_property
    def positives(self) -> DataFrame:
        return labels.positive_pairs(self.labels)

    @staged
    def negatives(self) -> DataFrame:
        return labels.training_negatives(
            self.labels, self.train_edges, self.settings.pure_negative_fraction, self.settings.seed
        )

    @staged
    def pairs(self) -> DataFrame:
        both = labels.labelled_pairs(self.positives, self.negatives)
        return labels.encode_pairs(both, self.codes, self.node_index)

    @staged
    def owners(self) -> DataFrame:
        wanted = self.triggers.where(F.col("split").isin(*self.settings.ranking_splits))
        return rankings.one_trigger_per_execution(wanted, self.codes)

    @staged
    def prod(self) -> DataFrame:
        return rankings.prod_results(
            rankings.prod_rankings(
                self.owners, self.logs, self.items, self.settings.top_k, self.listed, flat=False
            )
        )

    @staged
    def vectors(self) -> DataFrame:
        return entities.current_vectors(self.inputs.vectors, self.settings.model_id, self.inputs.accounts)

    @staged
    def features(self) -> DataFrame:
        return coview.node_features(self.node_index, self.vectors, self.settings.vector_dim)

    @staged
    def graph_triggers(self) -> DataFrame:
        inside = retrieval.graph_triggers(self.owners, self.node_index)
        return retrieval.with_category(inside, self.vectors)

    @staged
    def pool(self) -> DataFrame:
        return retrieval.candidate_pool(self.graph_triggers, self.vectors, self.node_index)

    @staged
    def exact_rows(self) -> DataFrame:
        return retrieval.exact_top_k(self.graph_triggers, self.pool, self.vectors, self.settings.top_k)

    @staged
    def approximate_rows(self) -> DataFrame:
        chosen = self.settings
        return inverted_lists.approximate_top_k(
            self.graph_triggers,
            self.pool,
            self.vectors,
            chosen.top_k,
            chosen.probes,
            chosen.list_recall,
            chosen.bounded,
            seed=chosen.seed,
        )

    @property
    def model_rows(self) -> DataFrame:
        return self.approximate_rows if self.settings.approximate else self.exact_rows

    @staged
    def model(self) -> DataFrame:
        return retrieval.model_results(self.graph_triggers, self.model_rows, self.items, self.listed)

    @cached_property
    def sizes(self) -> DataFrame:
        return evaluation.session_sizes(self.owners, evaluation.session_item_views(self.session_views))

    @staged
    def metrics(self) -> DataFrame:
        return evaluation.add_metrics(evaluation.assemble_arms(self.prod, self.model, self.sizes))

    @staged
    def metadata(self) -> DataFrame:
        return evaluation.product_metadata(
            self.owners, self.items, self.prod, self.model, self.inputs.catalog, self.inputs.accounts
        )
