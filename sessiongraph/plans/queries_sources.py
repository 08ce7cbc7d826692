"""Registered queries: tables, predicates, sources, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.functions.times import within_days
from sessiongraph.operators import sessions
from sessiongraph.plans.jobs import build_manifest
from sessiongraph.plans.registry import Run, query
from sessiongraph.session import new_path
from sessiongraph.sources import behavior, entities, fixtures, tables
from sessiongraph.streaming.matches import match_streams, run_available


@query(
    "a1_table_scan",
    "select event_type, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from events group by all",
)
def _(c: Run) -> DataFrame:
    rows = tables.load(c.spark, c.location, "events")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query("a2_artifact_scan", "select split, user_id, session_id, item_id, emitted, session_start from g_sv")
def _(c: Run) -> DataFrame:
    path = tables.write_artifact(c.session_views, new_path(c.spark, "session_views"))
    read = tables.read_artifact(c.spark, path, c.session_views.schema)
    return read.select("split", "user_id", "session_id", "item_id", "emitted", "session_start")


@query("a3_partitioned_sink", "select split, item_a, item_b, weight, raw_count from g_edges")
def _(c: Run) -> DataFrame:
    path = tables.write_artifact(c.edges, new_path(c.spark, "edges"), partition_by="split")
    return tables.read_artifact(c.spark, path).select("split", "item_a", "item_b", "weight", "raw_count")


@query(
    "a4_model_rows_sink",
    "select split, exec_code, item_id, round(score, 6) as score, cast(rank as int) as rank from g_model_rows",
)
def _(c: Run) -> DataFrame:
    path = tables.write_model_rows(c.model_rows, new_path(c.spark, "model_rows"))
    return tables.read_artifact(c.spark, path, tables.MODEL_ROWS)


@query(
    "a5_mapping_tables",
    """select 'node' as kind, 'all' as split, item_id as id, node_idx as code from g_nidx
       union all select 'execution', split, execution_id, exec_code from g_codes""",
)
def _(c: Run) -> DataFrame:
    nodes = c.node_index.select(
        F.lit("node").alias("kind"), F.lit("all").alias("split"), F.col("item_id").alias("id"),
        F.col("node_idx").alias("code"),
    )
    codes = c.codes.select(
        F.lit("execution").alias("kind"), "split", F.col("execution_id").alias("id"),
        F.col("exec_code").alias("code"),
    )
    path = tables.write_artifact(nodes.unionByName(codes), new_path(c.spark, "mappings"), partition_by="kind")
    return tables.read_artifact(c.spark, path).select("kind", "split", "id", "code")


@query(
    "a6_manifest",
    """select 'graph' as section, 'all' as split, 'num_nodes' as metric, cast(count(*) as double) as value
         from g_nidx
       union all select 'graph', 'all', 'nodes_without_embedding',
              cast(count(*) filter (where list_max(list_transform(vector, lambda x: abs(x))) = 0) as double)
         from g_features
       union all select 'graph', 'all', 'embedding_dim', max(len(vector))::double from g_features
       union all select 'co_view_edges', e.split, 'edges',
              cast(count(*) filter (where e.split = 'train' or t.item_a is null) as double)
         from g_edges e left join g_train t on t.item_a = e.item_a and t.item_b = e.item_b group by e.split
       union all select 'labelled_pairs', split, 'positive', cast(count(*) filter (where is_positive) as double)
         from g_pairs group by split
       union all select 'labelled_pairs', split, 'negative',
              cast(count(*) filter (where not is_positive) as double) from g_pairs group by split
       union all select 'production_mrr', split, 'matched', round(coalesce(avg(1.0 / best), 0), 6) from
         (select split, execution_id, min(best_positive_rank) as best from g_labels group by all) group by split
       union all select 'production_mrr', split, 'coverage', round(coalesce(sum(1.0 / best), 0) / count(*), 6) from
         (select split, execution_id, min(best_positive_rank) as best from g_labels group by all) group by split
    """,
)
def _(c: Run) -> DataFrame:
    return build_manifest(c)


@query(
    "b1_projection_cast",
    "select event_id, cast(item_id as varchar) as item_text, item_id as item_number, value as amount from g_events",
)
def _(c: Run) -> DataFrame:
    rows = fixtures.item_events(c.spark, c.location)
    return rows.select(
        "event_id",
        F.col("item_id").cast("string").alias("item_text"),
        F.expr("try_cast(cast(item_id as string) as bigint)").alias("item_number"),
        F.col("value").alias("amount"),
    )


@query(
    "b2_conjunctive_filter",
    """select item_id, db_name from g_catalog
       where db_name in ('db0', 'db2', 'db3') and is_active and is_in_stream and parent_id = -1""",
)
def _(c: Run) -> DataFrame:
    wanted = F.col("db_name").isin("db0", "db2", "db3")
    master = F.col("parent_id") == entities.MASTER_PARENT_ID
    return c.catalog.where(wanted & F.col("is_active") & F.col("is_in_stream") & master).select("item_id", "db_name")


@query(
    "b3_date_range",
    """select emitted, item_id, user_id from g_view_events
       where emitted >= timestamp '2024-01-05' and emitted < timestamp '2024-01-20'""",
)
def _(c: Run) -> DataFrame:
    return c.view_events.where(within_days("emitted", "2024-01-05", "2024-01-20")).select(
        "emitted", "item_id", "user_id"
    )


_EXPLODED = """select l.execution_id, c.placement_pos, c.candidate_pos, c.item_id, c.score
               from g_logs l join g_candidates c on l.execution_id = c.execution_id"""


def _flat_log(c: Run) -> DataFrame:
    placed = c.logs.select("execution_id", F.posexplode("placements").alias("placement_pos", "placement"))
    return placed.select(
        "execution_id",
        F.col("placement_pos").cast("long").alias("placement_pos"),
        F.posexplode("placement.candidates").alias("candidate_pos", "candidate"),
    ).withColumn("candidate_pos", F.col("candidate_pos").cast("long"))


@query(
    "b4_nested_null_test",
    f"select execution_id, placement_pos, candidate_pos, item_id from ({_EXPLODED}) where score is not null",
)
def _(c: Run) -> DataFrame:
    rows = _flat_log(c).where(F.col("candidate.score").isNotNull())
    return rows.select("execution_id", "placement_pos", "candidate_pos", "candidate.item_id")


@query(
    "b5_nested_fields",
    f"""select execution_id, placement_pos, count(*) as n_candidates, cast(sum(item_id) as bigint) as item_sum
        from ({_EXPLODED}) group by all""",
)
def _(c: Run) -> DataFrame:
    placed = c.logs.select("execution_id", F.posexplode("placements").alias("placement_pos", "placement"))
    ids = placed.withColumn("ids", F.col("placement.candidates.item_id"))
    return ids.select(
        "execution_id",
        F.col("placement_pos").cast("long").alias("placement_pos"),
        F.size("ids").cast("long").alias("n_candidates"),
        F.aggregate("ids", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("item_sum"),
    )


@query(
    "b6_conditional_columns",
    """select event_id, case when event_type = 'click' then 'log' when value > 50 then 'large' else 'other' end as kind
       from g_events""",
)
def _(c: Run) -> DataFrame:
    rows = fixtures.item_events(c.spark, c.location)
    kind = F.when(F.col("event_type") == "click", "log").when(F.col("value") > 50, "large").otherwise("other")
    return rows.select("event_id", kind.alias("kind"))


@query(
    "b7_null_replacement",
    f"""select execution_id, placement_pos, candidate_pos, coalesce(score, -1.0) as score, score is null as was_null
        from ({_EXPLODED})""",
)
def _(c: Run) -> DataFrame:
    score = F.col("candidate.score")
    return _flat_log(c).select(
        "execution_id",
        "placement_pos",
        "candidate_pos",
        F.coalesce(score, F.lit(-1.0)).alias("score"),
        score.isNull().alias("was_null"),
    )


@query(
    "c1_resolve_account",
    "select short_name, account_id, db_name, publisher_id from g_resolved",
)
def _(c: Run) -> DataFrame:
    return c.accounts


@query(
    "c1_resolve_account_left",
    """select a.short_name, a.public_id as account_id, a.db_name, p.id as publisher_id
       from g_accounts a join g_insights i on i.public_id = a.public_id and i.namespace = 'main'
       left join g_publishers p on p.insights_id = i.id""",
)
def _(c: Run) -> DataFrame:
    return entities.resolve_account(
        fixtures.accounts(c.spark, c.location),
        fixtures.insights_accounts(c.spark, c.location),
        fixtures.publishers(c.spark, c.location),
        require_publisher=False,
    )


@query(
    "c2_active_master_items",
    """select item_id, name, image_url from g_catalog where is_active and is_in_stream and parent_id = -1
       and db_name in (select db_name from g_resolved)""",
)
def _(c: Run) -> DataFrame:
    return entities.active_master_items(c.catalog, c.accounts)


@query(
    "c3_current_vectors",
    """select item_id, category, cast(2 as int) as updated_at, len(vector) as dim,
              round(list_sum(vector), 6) as total from g_vectors""",
)
def _(c: Run) -> DataFrame:
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return c.vectors.select(
        "item_id", "category", "updated_at", F.size("vector").cast("long").alias("dim"), total.alias("total")
    )


@query("c4_resolve_views", "select emitted, item_id, user_id from g_views")
def _(c: Run) -> DataFrame:
    return c.views


@query(
    "c5_match_logs",
    """select execution_id, log_instant, account_id, item_id, user_id, emitted, count(*) as copies
       from g_pairs_ts group by all""",
)
def _(c: Run) -> DataFrame:
    return behavior.match_logs_to_views(c.logs, c.view_events, c.identity)


@query(
    "c5_match_logs_of_accounts",
    """select execution_id, log_instant, account_id, item_id, user_id, emitted, count(*) as copies
       from g_pairs_ts where account_id in (select account_id from g_resolved)
       and execution_id in (select execution_id from g_logs where publisher_id in
                            (select publisher_id from g_resolved))
       and log_instant >= timestamp '2024-01-03' and log_instant < timestamp '2024-01-28'
       and emitted >= timestamp '2024-01-03' and emitted < timestamp '2024-01-28' group by all""",
)
def _(c: Run) -> DataFrame:
    return behavior.match_logs_to_views(
        c.logs, c.view_events, c.identity, c.accounts, c.accounts, "2024-01-03", "2024-01-28"
    )


@query(
    "x2_stream_match",
    """select execution_id, log_instant, account_id, item_id, user_id, emitted, count(*) as copies
       from g_pairs_ts group by all""",
)
def _(c: Run) -> DataFrame:
    """Both inputs as file streams."""
    needed = {
        "logs": c.logs.select("execution_id", "log_instant", "account_id", "item_id", "cookie", "page_type"),
        "views": c.view_events.select("account_id", "item_id", "cookie", "user_id", "emitted"),
    }
    streams = {}
    for name, df in needed.items():
        path = new_path(c.spark, name)
        df.write.parquet(path)
        streams[name] = c.spark.readStream.schema(df.schema).parquet(path)
    found = match_streams(streams["logs"], streams["views"], c.identity)
    out = new_path(c.spark, "stream_matches")
    run_available(found, out, new_path(c.spark, "stream_state"))
    pairs = c.spark.read.schema(found.schema).parquet(out)
    return pairs.groupBy(*pairs.columns).agg(F.count("*").alias("copies"))


@query(
    "c6_attach_sessions",
    """select execution_id, log_instant, account_id, item_id, user_id, emitted, session_id, split,
              count(*) as copies from g_matched group by all""",
)
def _(c: Run) -> DataFrame:
    return c.matched.select(
        "execution_id", "log_instant", "account_id", "item_id", "user_id", "emitted", "session_id", "split", "copies"
    )


@query(
    "c7_catalog_before_sessions",
    """select user_id, item_id, emitted, cast(sum(opens) over
              (partition by user_id order by emitted, item_id rows unbounded preceding) as bigint) as session_id
       from (select *, case when gap is null or gap > 14400 then 1 else 0 end as opens from
             (select *, date_diff('microsecond', lag(emitted) over
                     (partition by user_id order by emitted, item_id), emitted) // 1000000 as gap
              from g_views where item_id in (select item_id from g_catalog
                   where is_active and is_in_stream and parent_id = -1)))""",
)
def _(c: Run) -> DataFrame:
    kept = behavior.keep_catalog_items(c.views, entities.active_master_items(c.catalog))
    return sessions.sessionize(kept, fixtures.SESSION_TIMEOUT).select("user_id", "item_id", "emitted", "session_id")


@query("d1_sessionize", "select user_id, session_id, item_id, emitted from g_numbered")
def _(c: Run) -> DataFrame:
    cut = sessions.sessionize(c.views, fixtures.SESSION_TIMEOUT)
    return cut.select("user_id", "session_id", "item_id", "emitted")


@query("d2_session_start", "select user_id, session_id, item_id, emitted, session_start from g_started")
def _(c: Run) -> DataFrame:
    return sessions.sessionize(c.views, fixtures.SESSION_TIMEOUT)


@query(
    "d2_session_start_hot_users",
    "select user_id, session_id, item_id, emitted, session_start from g_started",
)
def _(c: Run) -> DataFrame:
    """So many partitions that most users go on from one into the next."""
    return sessions.sessionize(c.views, fixtures.SESSION_TIMEOUT, partitions=200)


@query("d3_time_split", "select user_id, session_id, item_id, emitted, session_start, split from g_sv")
def _(c: Run) -> DataFrame:
    cut = sessions.sessionize(c.views, fixtures.SESSION_TIMEOUT)
    return sessions.split_by_time(cut, fixtures.CUTOFF_TRAIN, fixtures.CUTOFF_VAL)


