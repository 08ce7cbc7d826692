"""Registered queries: three-arm evaluation, data checks, review sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.operators import coview, evaluation, labels, quality, review
from sessiongraph.plans import ledger
from sessiongraph.plans.publish import publish
from sessiongraph.plans.registry import Run, query
from sessiongraph.session import new_path
from sessiongraph.sources import behavior, entities, fixtures, tables


@query("l1_product_metadata", "select item_id, name, image_url from g_metadata")
def _(c: Run) -> DataFrame:
    return evaluation.product_metadata(c.owners, c.items, c.prod, c.model, c.catalog)


@query("l2_session_sizes", "select split, exec_code, trigger_id, session_views, session_size from g_session_sizes")
def _(c: Run) -> DataFrame:
    return evaluation.session_sizes(c.owners, evaluation.session_item_views(c.session_views))


@query(
    "l3_assemble_arms",
    """select split, exec_code, trigger_id, session_size, missing_model, model_answered,
              cast(n_model as int) as n_model, cast(n_display as int) as n_display,
              cast(n_relevance as int) as n_relevance from g_metrics""",
)
def _(c: Run) -> DataFrame:
    arms = evaluation.assemble_arms(c.prod, c.model, c.sizes)
    sizes = [F.size(f"products_returned_{arm}").alias(f"n_{arm}") for arm in evaluation.ARMS]
    return arms.select(
        "split", "exec_code", "trigger_id", "session_size", "missing_model", "model_answered", *sizes
    )


_ARM_COLUMNS = ", ".join(
    f"""cast(pos_{a} as int) as n_positives_{a}, found_{a}, round(recall_{a}, 6) as recall_{a},
        round(rr_{a}, 6) as rr_{a}"""
    for a in ("model", "display", "relevance")
)


@query("l4_trigger_metrics", f"select split, exec_code, {_ARM_COLUMNS} from g_metrics")
def _(c: Run) -> DataFrame:
    rows = evaluation.add_metrics(evaluation.assemble_arms(c.prod, c.model, c.sizes))
    names = [f"{m}_{a}" for a in evaluation.ARMS for m in ("n_positives", "found", "recall", "rr")]
    return rows.select("split", "exec_code", *names)


@query(
    "l5_population",
    """select count(*) as triggers, count(*) filter (where missing_model) as missing_model,
              count(*) filter (where not model_answered) as model_unanswered,
              count(*) filter (where session_size is null or session_size <= 0) as empty_session from g_metrics""",
)
def _(c: Run) -> DataFrame:
    return evaluation.population(c.metrics)


def _summary_sql(arm: str) -> str:
    return f"""select '{arm}' as arm, count(*) as triggers,
        count(*) filter (where recall_model is null) as recall_undefined,
        round(coalesce(avg(recall_{arm}), 0), 6) as avg_recall, round(avg(found_{arm}::int), 6) as pct_found,
        round(avg(pos_{arm}), 6) as avg_n_positives,
        round(coalesce(sum(rr_{arm}), 0) / count(*), 6) as mrr_coverage_adjusted,
        round(coalesce(avg(rr_{arm}), 0), 6) as mrr_matched_only, count(rr_{arm}) as matched from g_metrics"""


@query("l6_arm_summary", " union all ".join(_summary_sql(a) for a in ("model", "display", "relevance")))
def _(c: Run) -> DataFrame:
    return evaluation.arm_summary(c.metrics)


_CASE_VALUES = """(values ('both_find'), ('prod_only'), ('model_only'), ('neither')) k("case")"""


@query(
    "l7_case_matrix",
    f"""select t.arm, t.excluded, k."case", count(x."case") as count,
               round(count(x."case") * 100.0 / t.total, 6) as pct
        from (select arm, count(*) filter (where not model_answered) as excluded,
                     count(*) filter (where model_answered) as total from g_cases group by arm) t
        cross join {_CASE_VALUES}
        left join (select * from g_cases where model_answered) x on x.arm = t.arm and x."case" = k."case"
        group by t.arm, t.excluded, t.total, k."case" """,
)
def _(c: Run) -> DataFrame:
    return evaluation.case_matrix(c.metrics)


def _pair_overlap(a: str, b: str) -> str:
    return f"""select split, exec_code, count(*) as n from
        (select split, exec_code, item_id from g_arm_lists where arm = '{a}' intersect
         select split, exec_code, item_id from g_arm_lists where arm = '{b}') group by all"""


@query(
    "l8_list_overlap",
    f"""select count(*) as total_triggers, round(avg(m.n_model), 6) as avg_n_model,
               round(avg(m.n_display), 6) as avg_n_display, round(avg(m.n_relevance), 6) as avg_n_relevance,
               round(avg(coalesce(a.n, 0)), 6) as avg_ov_display_relevance,
               round(avg(coalesce(b.n, 0)), 6) as avg_ov_model_display,
               round(avg(coalesce(d.n, 0)), 6) as avg_ov_model_relevance,
               round(avg((coalesce(a.n, 0) = m.n_display and m.n_display = m.n_relevance)::int), 6)
                   as pct_display_eq_relevance
        from g_metrics m left join ({_pair_overlap("display", "relevance")}) a using (split, exec_code)
        left join ({_pair_overlap("model", "display")}) b using (split, exec_code)
        left join ({_pair_overlap("model", "relevance")}) d using (split, exec_code)""",
)
def _(c: Run) -> DataFrame:
    return evaluation.list_overlap(c.metrics)


@query(
    "l9_by_session_type",
    """select arm, session_type, count(*) as triggers, round(avg(found_model::int), 6) as pct_model_found,
              round(avg(recall_model), 6) as avg_recall_model, round(avg(recall), 6) as avg_recall_variant,
              round(coalesce(sum(rr_model), 0) / count(*), 6) as mrr_model_cov,
              round(coalesce(sum(rr), 0) / count(*), 6) as mrr_variant_cov
       from g_cases where session_size > 0 and model_answered group by arm, session_type""",
)
def _(c: Run) -> DataFrame:
    return evaluation.by_session_type(c.metrics)


@query(
    "l10_variant_crossing",
    """select k.verdict, count(x.verdict) as count,
              round(count(x.verdict) * 100.0 / (select count(*) from g_metrics where session_size > 0), 6) as pct
       from (values ('les_deux_trouvent'), ('display_seul'), ('relevance_seul'), ('aucun_ne_trouve')) k(verdict)
       left join (select case when found_display and found_relevance then 'les_deux_trouvent'
                              when found_display then 'display_seul' when found_relevance then 'relevance_seul'
                              else 'aucun_ne_trouve' end as verdict from g_metrics where session_size > 0) x
            on x.verdict = k.verdict group by k.verdict""",
)
def _(c: Run) -> DataFrame:
    return evaluation.variant_crossing(c.metrics)


_MATRICES = f"""select t.arm, t.session_type, k."case", count(x."case") as count,
               round(count(x."case") * 100.0 / t.total, 6) as pct
        from (select arm, session_type, count(*) as total from g_cases
              where model_answered and session_size > 0 group by all) t cross join {_CASE_VALUES}
        left join (select * from g_cases where model_answered and session_size > 0) x
             on x.arm = t.arm and x.session_type = t.session_type and x."case" = k."case"
        group by t.arm, t.session_type, t.total, k."case" """


@query("l11_matrices_by_session", _MATRICES)
def _(c: Run) -> DataFrame:
    return evaluation.matrices_by_session(c.metrics)


@query(
    "l12_session_content_keys",
    """select session_id, first_at, session_views, count(*) as sessions from
       (select user_id, session_id, min(emitted) as first_at, count(*) as session_views,
               list(item_id order by item_id) as content from g_sv group by user_id, session_id)
       group by session_id, first_at, session_views, content""",
)
def _(c: Run) -> DataFrame:
    keys = evaluation.session_content_keys(c.session_views)
    return keys.groupBy("session_key", "session_id", "first_at", "session_views").agg(
        F.count("*").alias("sessions")
    ).drop("session_key")


def _level_sql(v: str) -> str:
    return f"""select '{v}' as arm, case when any_{v} = 1 then 'positive' else 'full_negative' end as session_type,
        count(*) as sessions, round(avg(n_triggers), 6) as avg_triggers,
        round(avg(n_session_products), 6) as avg_session_products,
        round(avg(n_found_{v}), 6) as avg_triggers_finding, round(avg(any_model), 6) as pct_model_found,
        round(count(*) * 100.0 / (select count(*) from g_rollup), 6) as pct from g_rollup group by all"""


@query("l13_session_level", " union all ".join(_level_sql(v) for v in ("display", "relevance")))
def _(c: Run) -> DataFrame:
    return evaluation.session_level(evaluation.session_rollup(c.metrics))


@query(
    "l14_session_crossing",
    """select case when any_display = 1 then 'positive' else 'full_negative' end as type_display,
              count(*) filter (where any_relevance = 1) as relevance_positive,
              count(*) filter (where any_relevance = 0) as relevance_full_negative from g_rollup group by 1""",
)
def _(c: Run) -> DataFrame:
    return evaluation.session_crossing(evaluation.session_rollup(c.metrics))


@query(
    "m1_lost_endpoints",
    """select count(*) as edges, count(*) filter (where a.node_idx is null or b.node_idx is null) as lost
       from g_edges e left join g_nidx a on a.item_id = e.item_a and a.item_id in (select item_a from g_train)
       left join g_nidx b on b.item_id = e.item_b and b.item_id in (select item_a from g_train)""",
)
def _(c: Run) -> DataFrame:
    left_ends = c.train_edges.select(F.col("item_a").alias("item_id")).distinct()
    partial = c.node_index.join(left_ends, "item_id", "left_semi")
    return quality.lost_endpoints(coview.remap_edges(c.edges, partial))


@query(
    "m2_index_range",
    """select count(*) as pairs, min(least(src, dst)) as lowest, max(greatest(src, dst)) as highest,
              count(*) filter (where src < 0 or dst < 0 or src >= (select count(*) from g_nidx)
                               or dst >= (select count(*) from g_nidx)) as out_of_range from g_pairs""",
)
def _(c: Run) -> DataFrame:
    return quality.index_range(c.pairs, c.node_index.agg(F.count("*")).scalar())


@query(
    "m3_zero_vectors",
    """select count(*) as nodes, count(*) filter (where z) as missing, round(avg(z::int), 6) as missing_ratio
       from (select list_max(list_transform(vector, lambda x: abs(x))) = 0 as z from g_features)""",
)
def _(c: Run) -> DataFrame:
    return quality.zero_vectors(c.features)


@query(
    "m4_counts_match",
    """select 'triggers' as label, count(c.exec_code) as actual, count(*) as expected,
              count(*) - count(c.exec_code) as lost
       from g_triggers t left join g_codes c on c.split = t.split and c.execution_id = t.execution_id""",
)
def _(c: Run) -> DataFrame:
    return quality.counts_match(c.triggers.join(c.codes, labels.EXECUTION), c.triggers, "triggers")


@query("m5_node_count", "select count(*) as n_nodes, count(*) = 100 as as_expected from g_nidx")
def _(c: Run) -> DataFrame:
    return quality.node_count(c.node_index, 100)


@query("m6_alignment", "select count(*) as compared, 0::bigint as mismatched from g_gtriggers")
def _(c: Run) -> DataFrame:
    return quality.alignment(c.prod, c.model)


@query(
    "m7_impossible_cells",
    f"""select arm, session_type, cast(sum(count) as bigint) as cells from ({_MATRICES})
        where (session_type = 'positive' and "case" in ('model_only', 'neither'))
           or (session_type = 'full_negative' and "case" in ('both_find', 'prod_only')) group by all""",
)
def _(c: Run) -> DataFrame:
    return quality.impossible_cells(evaluation.matrices_by_session(c.metrics))


@query(
    "m8_loss_ledger",
    """select 'catalog' as step, count(*) as rows_in, count(*) filter (where item_id in
              (select item_id from g_catalog where is_active and is_in_stream and parent_id = -1)) as rows_out
         from g_views
       union all select 'page_type', count(*), count(*) filter (where page_type = 'PRODUCT') from g_logs
       union all select 'known_pairs', (select count(*) from g_edges where split <> 'train'), count(*)
         from g_edges e where split <> 'train' and not exists
              (select 1 from g_train t where t.item_a = e.item_a and t.item_b = e.item_b)
       union all select 'encode', (select count(*) from g_positives) + (select count(*) from g_kept), count(*)
         from g_pairs
       union all select 'categorized', count(*), count(category) from g_gtriggers""",
)
def _(c: Run) -> DataFrame:
    kept = behavior.keep_catalog_items(c.views, entities.active_master_items(c.catalog))
    held = c.edges.where(F.col("split") != "train")
    both = labels.labelled_pairs(c.positives, c.negatives)
    return quality.loss_ledger(
        [
            ("catalog", c.views, kept),
            ("page_type", c.logs, c.logs.where(F.col("page_type") == behavior.PRODUCT_PAGE)),
            ("known_pairs", held, coview.remove_known_pairs(held, c.train_edges)),
            ("encode", both, c.pairs),
            ("categorized", c.graph_triggers, c.graph_triggers.where(F.col("category").isNotNull())),
        ]
    )


_WINDOW = ("2024-01-03", "2024-01-29")


@query(
    "m8_all_exclusions",
    f"""select 'e01_publisher' as step, count(*) as rows_in, count(*) filter (where public_id in
              (select account_id from g_resolved)) as rows_out from g_accounts
       union all select 'e02_active', count(*), count(*) filter (where is_active and is_in_stream) from g_catalog
       union all select 'e03_master', count(*), count(*) filter (where parent_id = -1)
         from g_catalog where is_active and is_in_stream
       union all select 'e04_model_version', sum(n)::bigint, (sum(n) filter (where current))::bigint from
         (select vec_id % 20 <> 3 as current, case when vec_id % 3 = 0 then 2 else 1 end as n from embeddings)
       union all select 'e05_known_user', count(*), count(user_id) from g_view_events
       union all select 'e06_known_item', count(user_id), count(*) filter (where user_id is not null
         and item_id is not null) from g_view_events
       union all select 'e07_date', count(*), count(*) filter (where emitted >= timestamp '{_WINDOW[0]}'
         and emitted < timestamp '{_WINDOW[1]}') from g_view_events where user_id is not null and item_id is not null
       union all select 'e08_catalog', count(*), count(*) filter (where item_id in
              (select item_id from g_catalog where is_active and is_in_stream and parent_id = -1)) from g_views
       union all select 'e09_two_items', count(*), count(*) filter (where session_size > 1) from g_sizes
       union all select 'e10_not_in_train', count(*), count(*) filter (where not exists
              (select 1 from g_train t where t.item_a = e.item_a and t.item_b = e.item_b))
         from g_edges e where split <> 'train'
       union all select 'e11_matched_log', count(*), (select count(distinct execution_id) from g_pairs_ts) from g_logs
       union all select 'e12_session_found', count(distinct execution_id),
              (select count(distinct execution_id) from g_matched) from g_pairs_ts
       union all select 'e13_has_candidates', count(*), count(*) filter (where execution_id in
              (select execution_id from g_candidates)) from g_triggers
       union all select 'e14_depth', count(*), count(*) filter (where candidate_pos < 12)
         from g_triggers t join g_candidates c on c.execution_id = t.execution_id
       union all select 'e15_no_train_edge', (select count(*) from g_labels where not is_positive), count(*)
         from g_negatives
       union all select 'e16_above_deepest', count(*), (select count(*) from g_kept)
         from g_negatives n join g_deepest d on n.split = d.split and n.execution_id = d.execution_id
       union all select 'e17_drawn_execution', count(*), 0 from g_negatives n where not exists
              (select 1 from g_deepest d where n.split = d.split and n.execution_id = d.execution_id)
       union all select 'e18_in_graph', (select count(*) from g_positives) + (select count(*) from g_kept), count(*)
         from g_pairs
       union all select 'e19_one_trigger', count(*), (select count(*) from g_owners) from g_triggers""",
)
def _(c: Run) -> DataFrame:
    """All exclusions of a run, with a window of dates that leaves some views out."""
    everything = fixtures.accounts(c.spark, c.location)
    return ledger.loss_ledger(c, (everything, c.accounts), *_WINDOW)


@query(
    "m9_conflicting_values",
    """select 'master' as dependency, count(*) as keys, count(*) filter (where n > 1) as conflicts from
         (select source_id, count(distinct master_id) as n from g_identity group by all)
       union all select 'trigger', count(*), count(*) filter (where n > 1) from
         (select split, execution_id, count(distinct trigger_id) as n from g_triggers group by all)
       union all select 'log_instant', count(*), count(*) filter (where n > 1) from
         (select cookie, item_id, count(distinct log_instant) as n from g_logs group by all)
       union all select 'given_vector', count(*), count(*) filter (where n > 1) from
         (select vec_id, count(distinct vector) as n from
            (select vec_id, embedding as vector from embeddings
             union all select vec_id, list_transform(embedding, lambda x: -x) from embeddings where vec_id % 3 = 0)
          group by all)
       union all select 'current_vector', count(*), count(*) filter (where n > 1) from
         (select item_id, count(distinct vector) as n from g_vectors group by all)""",
)
def _(c: Run) -> DataFrame:
    def named(name: str, report: DataFrame) -> DataFrame:
        return report.select(F.lit(name).alias("dependency"), "keys", "conflicts")

    return (
        named("master", quality.conflicting_values(c.identity, ["source_id"], "master_id"))
        .unionByName(named("trigger", quality.conflicting_values(c.triggers, labels.EXECUTION, "trigger_id")))
        .unionByName(
            named("log_instant", quality.conflicting_values(c.logs, ["cookie", "item_id"], "log_instant"))
        )
        .unionByName(named("given_vector", quality.conflicting_values(c.inputs.vectors, ["item_id"], "vector")))
        .unionByName(named("current_vector", quality.conflicting_values(c.vectors, ["item_id"], "vector")))
    )


@query("n1_display_sample", "select split, exec_code, trigger_id, execution_id, user_id, session_id from g_sample")
def _(c: Run) -> DataFrame:
    rows = review.display_sample(c.owners, c.prod)
    return rows.select("split", "exec_code", "trigger_id", "execution_id", "user_id", "session_id")


@query(
    "n2_enriched_products",
    """select p.split, p.exec_code, 'products_returned_' || p.variant as list, cast(p.rank as int) as rank,
              p.item_id, m.name, m.image_url from g_prod p left join g_metadata m on m.item_id = p.item_id
       union all
       select p.split, p.exec_code, 'positives_' || p.variant, cast(p.rank as int), p.item_id, m.name, m.image_url
       from g_prod p left join g_metadata m on m.item_id = p.item_id where p.seen""",
)
def _(c: Run) -> DataFrame:
    columns = [f"{name}_{v}" for name in ("products_returned", "positives") for v in ("display", "relevance")]
    return review.enriched_products(c.prod, columns, c.metadata)


_REFERENCED = """select trigger_id as item_id from g_sample
       union select v.item_id from g_sv v join g_sample s on s.split = v.split and s.user_id = v.user_id
             and s.session_id = v.session_id
       union select p.item_id from g_prod p join g_sample s on s.split = p.split and s.exec_code = p.exec_code
       union select m.item_id from g_model m join g_sample s on s.split = m.split and s.exec_code = m.exec_code"""


def _referenced(c: Run) -> DataFrame:
    prod_lists = ["products_returned_display", "products_returned_relevance"]
    return review.referenced_items(
        c.sample, c.session_views, [(c.prod, prod_lists), (c.model, ["products_returned"])]
    )


@query("n3_referenced_items", _REFERENCED)
def _(c: Run) -> DataFrame:
    return _referenced(c)


@query(
    "n4_reduced_tables",
    """select 'prod' as source, p.split, p.exec_code, p.item_id, cast(p.rank as int) as rank from g_prod p
       join g_sample s on s.split = p.split and s.exec_code = p.exec_code where p.variant = 'display'
       union all select 'model', m.split, m.exec_code, m.item_id, cast(m.rank as int) from g_model m
       join g_sample s on s.split = m.split and s.exec_code = m.exec_code""",
)
def _(c: Run) -> DataFrame:
    def flat(source: str, table: DataFrame, column: str) -> DataFrame:
        rows = review.keep_sample(table, c.sample).select("split", "exec_code", F.inline(column))
        return rows.select(F.lit(source).alias("source"), "split", "exec_code", "item_id", "rank")

    return flat("prod", c.prod, "products_returned_display").unionByName(
        flat("model", c.model, "products_returned")
    )


@query(
    "n5_written_sample",
    """select 'prod' as source, 0 as drifted_columns, count(distinct (split, exec_code)) as rows_before,
              count(distinct (split, exec_code)) as rows_after from g_prod join g_sample using (split, exec_code)
       union all select 'owners', 0, count(*), count(*) from g_owners""",
)
def _(c: Run) -> DataFrame:
    """Tables written and read back: columns that changed type and row counts on both sides."""
    reports = []
    for source, table in (("prod", review.keep_sample(c.prod, c.sample)), ("owners", c.owners)):
        path = tables.write_artifact(table, new_path(c.spark, source))
        read = tables.read_artifact(c.spark, path)
        drift = len(quality.schema_drift(read, table.schema))
        counts = quality.counts_match(read, table, source)
        reports.append(
            counts.select(
                F.lit(source).alias("source"),
                F.lit(drift).alias("drifted_columns"),
                F.col("expected").alias("rows_before"),
                F.col("actual").alias("rows_after"),
            )
        )
    return reports[0].unionByName(reports[1])


@query(
    "n5_published_sample",
    """select 'owners' as source, 0 as drifted_columns, count(*) as rows_before, count(*) as rows_after,
              true as published from g_sample
       union all select 'sessions', 0, count(*), count(*), true from g_sv v where exists (select 1 from g_sample s
              where s.split = v.split and s.user_id = v.user_id and s.session_id = v.session_id)
       union all select 'prod', 0, count(distinct (split, exec_code)), count(distinct (split, exec_code)), true
         from g_prod join g_sample using (split, exec_code)
       union all select 'model', 0, count(*), count(*), true from g_gtriggers join g_sample using (split, exec_code)
       union all select 'drifted', 2, count(*), null, false from g_sample""",
)
def _(c: Run) -> DataFrame:
    """All four tables of the sample, and one whose code became text and whose trigger is missing."""
    drifted = c.sample.withColumn("exec_code", F.col("exec_code").cast("string")).drop("trigger_id")
    viewed = c.session_views.join(c.sample.select(*review.SESSION).distinct(), review.SESSION, "left_semi")
    sources = {
        "owners": (c.sample, c.owners.schema),
        "sessions": (viewed, c.session_views.schema),
        "prod": (review.keep_sample(c.prod, c.sample), c.prod.schema),
        "model": (review.keep_sample(c.model, c.sample), c.model.schema),
        "drifted": (drifted, c.owners.schema),
    }
    reports = [publish(table, new_path(c.spark, name), schema, name) for name, (table, schema) in sources.items()]
    return reduce(DataFrame.unionByName, reports)


@query(
    "t5_distinct_recall",
    """select * from (with ours as (select o.split, o.exec_code, o.trigger_id,
             (select count(*) from g_items i where i.split = o.split and i.user_id = o.user_id
                and i.session_id = o.session_id and i.item_id <> o.trigger_id) as others from g_owners o)
       select o.split, o.exec_code, a.arm, count(distinct l.item_id) / nullif(o.others, 0) as recall_distinct
       from ours o cross join (values ('model'), ('display'), ('relevance')) a(arm)
       left join g_arm_lists l on l.split = o.split and l.exec_code = o.exec_code and l.arm = a.arm and l.seen
            and l.item_id <> o.trigger_id
       group by o.split, o.exec_code, a.arm, o.others)""",
)
def _(c: Run) -> DataFrame:
    return evaluation.distinct_recall(c.metrics, evaluation.session_item_views(c.session_views))


@query(
    "n6_replay_checks",
    f"""select 'sessions' as "check", count(*) as value from g_sample
        union all select 'missing_sessions', greatest(20 - count(*), 0) from g_sample
        union all select 'repeated_metadata', 0
        union all select 'dropped', count(*) from ({_REFERENCED}) r
          where r.item_id not in (select item_id from g_cited) and r.item_id in (select item_id from g_catalog)
        union all select 'unknown', count(*) from ({_REFERENCED}) r
          where r.item_id not in (select item_id from g_cited) and r.item_id not in (select item_id from g_catalog)
        union all select 'empty_lists', count(*) from g_sample s where not exists
          (select 1 from g_model m where m.split = s.split and m.exec_code = s.exec_code)""",
)
def _(c: Run) -> DataFrame:
    return review.replay_checks(c.sample, c.model, "products_returned", _referenced(c), c.metadata, c.catalog)


@query(
    "n7_label_class",
    """select split, exec_code, arm, cast(rank as int) as rank, item_id,
              case when seen then 'positive' else 'negative' end as label_class from g_arm_lists""",
)
def _(c: Run) -> DataFrame:
    """The classes of all three lists."""
    model = review.labelled_list(c.model, "products_returned", "positives", "negatives")
    rows = model.withColumn("arm", F.lit("model"))
    for arm in ("display", "relevance"):
        names = (f"products_returned_{arm}", f"positives_{arm}", f"negatives_{arm}")
        rows = rows.unionByName(review.labelled_list(c.prod, *names).withColumn("arm", F.lit(arm)))
    return rows


@query(
    "n8_first_occurrence",
    """select o.split, o.exec_code, min(v.place) as first_index from g_owners o
       left join (select split, user_id, session_id, item_id,
                         row_number() over (partition by split, user_id, session_id
                                            order by emitted, item_id) - 1 as place from g_sv) v
            on v.split = o.split and v.user_id = o.user_id and v.session_id = o.session_id
            and v.item_id = o.trigger_id group by o.split, o.exec_code""",
)
def _(c: Run) -> DataFrame:
    return review.first_occurrence(c.owners, c.session_views)
