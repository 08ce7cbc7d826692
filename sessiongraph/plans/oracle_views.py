"""Named SQL views over the driver tables, used to check the Spark results with another engine.

`with_views(sql)` puts the views a statement needs, directly or through others, in front of it.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "g_nums": "select unnest(range(16)) as n",
    "g_events": """
        select event_id, user_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as item_id,
               ts, event_type, value from events""",
    "g_identity": """
        select distinct user_id as source_id, user_id - 1 as master_id from events where user_id % 10 = 1""",
    "g_view_events": """
        select concat('a', user_id % 25) as account_id, ts as emitted, item_id, user_id, user_id as cookie
        from g_events""",
    "g_views": """
        select v.emitted, v.item_id, coalesce(i.master_id, v.user_id) as user_id
        from g_view_events v left join g_identity i on v.user_id = i.source_id""",
    "g_logs": """
        select event_id as execution_id, ts + cast(event_id % 9 - 4 as int) * interval 1 second as log_instant,
               concat('a', user_id % 25) as account_id, concat('p', event_id % 100) as publisher_id,
               user_id as cookie, item_id,
               case when event_id % 10 = 0 then 'SEARCH' else 'PRODUCT' end as page_type,
               case when event_id % 4 = 0 then 2 else 1 end as n_placements
        from g_events where event_type = 'click'""",
    "g_candidates": """
        select l.execution_id, p.n as placement_pos, c.n as candidate_pos,
               (l.item_id * 7 + c.n * 13 + p.n * 5) % 100 as item_id,
               case when (l.execution_id + c.n) % 17 = 0 then null
                    else cast((((l.item_id * 7 + c.n * 13 + p.n * 5) % 100) * 37 + l.execution_id) % 101
                              as double) / 100.0 end as score
        from g_logs l join g_nums p on p.n < l.n_placements cross join g_nums c""",
    "g_catalog": """
        select distinct item_id, concat('db', item_id % 5) as db_name, item_id % 10 <> 9 as is_active,
               item_id % 7 <> 6 as is_in_stream,
               case when item_id % 11 = 10 then item_id - 1 else -1 end as parent_id,
               concat('item ', item_id) as name, concat('img/', item_id) as image_url
        from g_events""",
    "g_accounts": """
        select n_name as short_name, concat('a', n_nationkey) as public_id,
               concat('db', n_regionkey) as db_name from nation""",
    "g_insights": """
        select s_suppkey as id, concat('a', s_nationkey) as public_id,
               case when s_suppkey % 3 = 0 then 'other' else 'main' end as namespace from supplier""",
    "g_publishers": """
        select concat('p', s_suppkey) as id, s_suppkey as insights_id from supplier where s_suppkey % 4 <> 1""",
    "g_resolved": """
        select a.short_name, a.public_id as account_id, a.db_name, p.id as publisher_id
        from g_accounts a join g_insights i on i.public_id = a.public_id and i.namespace = 'main'
        join g_publishers p on p.insights_id = i.id""",
    "g_gaps": """
        select *, date_diff('microsecond',
                            lag(emitted) over (partition by user_id order by emitted, item_id),
                            emitted) // 1000000 as gap from g_views""",
    "g_numbered": """
        select *, cast(sum(case when gap is null or gap > 14400 then 1 else 0 end)
                       over (partition by user_id order by emitted, item_id rows unbounded preceding)
                       as bigint) as session_id from g_gaps""",
    "g_started": """
        select user_id, session_id, item_id, emitted,
               min(emitted) over (partition by user_id, session_id) as session_start from g_numbered""",
    "g_sv": """
        select *, case when session_start < timestamp '2024-01-21' then 'train'
                       when session_start < timestamp '2024-01-26' then 'val' else 'test' end as split
        from g_started""",
    "g_items": "select distinct split, user_id, session_id, item_id from g_sv",
    "g_sizes": "select split, user_id, session_id, count(*) as session_size from g_items group by all",
    "g_edges": """
        select a.split, a.item_id as item_a, b.item_id as item_b, cast(count(*) as double) as weight,
               count(*) as raw_count
        from g_items a join g_items b on a.user_id = b.user_id and a.session_id = b.session_id
             and a.item_id < b.item_id
        group by all""",
    "g_train": "select item_a, item_b, weight, raw_count from g_edges where split = 'train'",
    "g_nodes": "select item_a as item_id from g_edges union select item_b from g_edges",
    "g_nidx": "select item_id, row_number() over (order by item_id) - 1 as node_idx from g_nodes",
    "g_train_idx": """
        select a.node_idx as src, b.node_idx as dst, t.weight from g_train t
        join g_nidx a on a.item_id = t.item_a join g_nidx b on b.item_id = t.item_b""",
    "g_sym": "select src, dst, weight from g_train_idx union all select dst, src, weight from g_train_idx",
    "g_pairs_ts": """
        select l.execution_id, l.log_instant, l.account_id, l.item_id,
               coalesce(i.master_id, v.user_id) as user_id, v.emitted
        from g_logs l join g_view_events v on l.account_id = v.account_id and l.item_id = v.item_id
             and l.cookie = v.cookie
             and v.emitted between l.log_instant - interval 3 second and l.log_instant + interval 3 second
        left join g_identity i on v.user_id = i.source_id
        where l.page_type = 'PRODUCT'""",
    "g_matched": """
        select m.*, s.session_id, s.split from g_pairs_ts m
        join g_sv s on m.item_id = s.item_id and m.emitted = s.emitted and m.user_id = s.user_id""",
    "g_triggers": """
        select distinct split, user_id, session_id, execution_id, item_id as trigger_id from g_matched""",
    "g_codes": """
        select split, execution_id, row_number() over (partition by split order by execution_id) - 1 as exec_code
        from (select distinct split, execution_id from g_triggers)""",
    "g_offered": """
        select t.split, t.user_id, t.session_id, t.execution_id, t.trigger_id, c.item_id,
               c.candidate_pos + 1 as rank, s.item_id is not null as seen
        from g_triggers t join g_candidates c on t.execution_id = c.execution_id and c.candidate_pos < 12
        left join g_items s on s.split = t.split and s.user_id = t.user_id and s.session_id = t.session_id
             and s.item_id = c.item_id""",
    "g_labels": """
        select split, execution_id, trigger_id, item_id, min(rank) as rank, bool_or(seen) as is_positive,
               min(rank) filter (where seen) as best_positive_rank,
               max(rank) filter (where seen) as deepest_positive_rank
        from g_offered group by all""",
    "g_positives": "select split, execution_id, trigger_id, item_id from g_labels where is_positive",
    "g_known": "select item_a, item_b from g_train union select item_b, item_a from g_train",
    "g_unknown": """
        select * from g_labels l where not exists
        (select 1 from g_known k where k.item_a = l.trigger_id and k.item_b = l.item_id)""",
    "g_negatives": "select * from g_unknown where not is_positive",
    "g_deepest": """
        select split, execution_id, max(deepest_positive_rank) as deepest
        from g_labels where is_positive group by all""",
    "g_kept": """
        select n.split, n.execution_id, n.trigger_id, n.item_id, n.rank
        from g_negatives n join g_deepest d on n.split = d.split and n.execution_id = d.execution_id
        where n.rank <= d.deepest""",
    "g_pairs": """
        select p.split, c.exec_code, a.node_idx as src, b.node_idx as dst, p.is_positive
        from (select split, execution_id, trigger_id, item_id, true as is_positive from g_positives
              union all select split, execution_id, trigger_id, item_id, false from g_kept) p
        join g_codes c on c.split = p.split and c.execution_id = p.execution_id
        join g_nidx a on a.item_id = p.trigger_id join g_nidx b on b.item_id = p.item_id""",
    "g_owners": """
        select t.split, t.execution_id, t.trigger_id, t.user_id, t.session_id, c.exec_code
        from (select *, row_number() over (partition by split, execution_id
                                           order by trigger_id, user_id, session_id) as place
              from g_triggers) t
        join g_codes c on c.split = t.split and c.execution_id = t.execution_id where place = 1""",
    "g_placed": """
        select execution_id, placement_pos, item_id, 'display' as variant, candidate_pos + 1 as pos
        from g_candidates where candidate_pos < 12
        union all
        select execution_id, placement_pos, item_id, 'relevance', pos from
        (select *, row_number() over (partition by execution_id, placement_pos
                                      order by score desc nulls last, item_id) as pos from g_candidates)
        where pos <= 12""",
    "g_lists": """
        select * from
        (select execution_id, variant, item_id,
                row_number() over (partition by execution_id, variant order by min(pos), item_id) as rank
         from g_placed group by execution_id, variant, item_id) where rank <= 12""",
    "g_prod": """
        select o.split, o.exec_code, o.trigger_id, o.execution_id, o.user_id, o.session_id, l.variant, l.rank,
               l.item_id, s.item_id is not null as seen
        from g_owners o join g_lists l on l.execution_id = o.execution_id
        left join g_items s on s.split = o.split and s.user_id = o.user_id and s.session_id = o.session_id
             and s.item_id = l.item_id""",
    "g_vectors": """
        select vec_id as item_id, cast(embedding as double[]) as vector,
               case when vec_id % 25 = 0 then null else concat('c', label) end as category
        from embeddings where vec_id % 20 <> 3""",
    "g_units": """
        select item_id, category,
               list_transform(vector, lambda x: x / greatest(sqrt(list_dot_product(vector, vector)), 1e-12)) as u
        from g_vectors""",
    "g_gtriggers": """
        select o.*, n.node_idx, v.category from g_owners o join g_nidx n on n.item_id = o.trigger_id
        left join g_vectors v on v.item_id = o.trigger_id""",
    "g_pool": """
        select distinct v.category, v.item_id from g_vectors v join g_nidx n on n.item_id = v.item_id
        where v.category in (select category from g_gtriggers)""",
    "g_scored": """
        select q.item_id as trigger_id, p.item_id, list_dot_product(q.u, r.u) as score
        from g_units q join g_pool p on p.category = q.category and p.item_id <> q.item_id
        join g_units r on r.item_id = p.item_id
        where q.item_id in (select trigger_id from g_gtriggers)""",
    "g_top": """
        select * from (select *, row_number() over (partition by trigger_id order by score desc, item_id) as rank
                       from g_scored) where rank <= 12""",
    "g_model_rows": """
        select g.split, g.exec_code, t.item_id, t.score, t.rank from g_gtriggers g
        join g_top t on t.trigger_id = g.trigger_id where g.category is not null""",
    "g_model": """
        select g.split, g.exec_code, g.trigger_id, m.item_id, m.score, m.rank, s.item_id is not null as seen
        from g_gtriggers g join g_model_rows m on m.split = g.split and m.exec_code = g.exec_code
        left join g_items s on s.split = g.split and s.user_id = g.user_id and s.session_id = g.session_id
             and s.item_id = m.item_id""",
    "g_item_views": "select split, user_id, session_id, item_id, count(*) as views from g_sv group by all",
    "g_session_sizes": """
        select o.split, o.exec_code, o.trigger_id, cast(t.n as bigint) as session_views,
               cast(t.n - coalesce(v.views, 0) as bigint) as session_size
        from g_owners o
        join (select split, user_id, session_id, sum(views) as n from g_item_views group by all) t
             on t.split = o.split and t.user_id = o.user_id and t.session_id = o.session_id
        left join g_item_views v on v.split = o.split and v.user_id = o.user_id
             and v.session_id = o.session_id and v.item_id = o.trigger_id""",
    "g_arm_lists": """
        select split, exec_code, variant as arm, rank, item_id, seen from g_prod
        union all select split, exec_code, 'model', rank, item_id, seen from g_model""",
    "g_arm": """
        select o.split, o.exec_code, a.arm, count(l.item_id) as n_listed,
               count(*) filter (where l.seen) as n_positives,
               min(l.rank) filter (where l.seen) as best_rank
        from g_owners o cross join (values ('model'), ('display'), ('relevance')) a(arm)
        left join g_arm_lists l on l.split = o.split and l.exec_code = o.exec_code and l.arm = a.arm
        group by all""",
    "g_metrics": """
        select o.split, o.exec_code, o.trigger_id, o.user_id, o.session_id, z.session_views, z.session_size,
               g.exec_code is null as missing_model, m.n_listed > 0 as model_answered,
               m.n_listed as n_model, d.n_listed as n_display, r.n_listed as n_relevance,
               m.n_positives as pos_model, d.n_positives as pos_display, r.n_positives as pos_relevance,
               m.n_positives > 0 as found_model, d.n_positives > 0 as found_display,
               r.n_positives > 0 as found_relevance,
               case when z.session_size > 0 then m.n_positives / z.session_size end as recall_model,
               case when z.session_size > 0 then d.n_positives / z.session_size end as recall_display,
               case when z.session_size > 0 then r.n_positives / z.session_size end as recall_relevance,
               1.0 / m.best_rank as rr_model, 1.0 / d.best_rank as rr_display, 1.0 / r.best_rank as rr_relevance
        from g_owners o join g_session_sizes z on z.split = o.split and z.exec_code = o.exec_code
        left join g_gtriggers g on g.split = o.split and g.exec_code = o.exec_code
        join g_arm m on m.split = o.split and m.exec_code = o.exec_code and m.arm = 'model'
        join g_arm d on d.split = o.split and d.exec_code = o.exec_code and d.arm = 'display'
        join g_arm r on r.split = o.split and r.exec_code = o.exec_code and r.arm = 'relevance'""",
    "g_by_variant": """
        select 'display' as arm, found_display as found, recall_display as recall, rr_display as rr, *
        from g_metrics
        union all select 'relevance', found_relevance, recall_relevance, rr_relevance, * from g_metrics""",
    "g_cases": """
        select *, case when found then 'positive' else 'full_negative' end as session_type,
               case when found_model and found then 'both_find' when found then 'prod_only'
                    when found_model then 'model_only' else 'neither' end as "case" from g_by_variant""",
    "g_rollup": """
        select split, user_id, session_id, count(*) as n_triggers, max(session_views) as n_session_products,
               max(found_model::int) as any_model, max(found_display::int) as any_display,
               max(found_relevance::int) as any_relevance, sum(found_display::int) as n_found_display,
               sum(found_relevance::int) as n_found_relevance
        from g_metrics group by all""",
    "g_cited": """
        select i.item_id from g_items i where exists
            (select 1 from g_owners o where o.split = i.split and o.user_id = i.user_id
             and o.session_id = i.session_id)
        union select item_id from g_prod union select item_id from g_model
        union select trigger_id from g_owners""",
    "g_metadata": """
        select c.item_id, m.name, m.image_url from g_cited c
        left join (select item_id, min(name) as name, min(image_url) as image_url from g_catalog group by all) m
             on m.item_id = c.item_id""",
    "g_sample": """
        select * from
        (select *, row_number() over (partition by split, trigger_id order by exec_code) as place from g_owners)
        where place = 1 order by ((exec_code % 1000003) * 7919 + 56) % 1000003, split, exec_code limit 20""",
    "g_scores": """
        select l_orderkey as group_id, case when l_returnflag = 'R' then 1 else 0 end as label,
               cast(round(l_discount * 100) as double) - 5.0 as score, l_linenumber as line_no,
               l_partkey as item_id from lineitem""",
    "g_pos": "select group_id, score from g_scores where label = 1",
    "g_neg": "select group_id, score from g_scores where label = 0",
    "g_baskets": """
        select o_custkey as user_id, o_orderkey as session_id, l_partkey as item_id, o_orderdate as emitted,
               case when o_orderdate < timestamp '2000-01-01' then 'train'
                    when o_orderdate < timestamp '2000-10-01' then 'val' else 'test' end as split
        from lineitem join orders on l_orderkey = o_orderkey""",
    "g_basket_items": "select distinct split, user_id, session_id, item_id from g_baskets",
    "g_baskets_pairs": """
        select distinct a.split, a.item_id as item_a, b.item_id as item_b
        from g_basket_items a join g_basket_items b on a.user_id = b.user_id and a.session_id = b.session_id
             and a.split = b.split and a.item_id < b.item_id""",
    "g_basket_nodes": """
        select item_id, row_number() over (order by item_id) - 1 as node_idx
        from (select distinct item_id from g_baskets)""",
    "g_basket_edges": """
        select distinct x.node_idx as src, y.node_idx as dst
        from g_basket_items a join g_basket_items b on a.user_id = b.user_id and a.session_id = b.session_id
             and a.item_id < b.item_id
        join g_basket_nodes x on x.item_id = a.item_id join g_basket_nodes y on y.item_id = b.item_id
        where a.split = 'train'""",
    "g_basket_starts": """
        select node_idx as lo, node_idx * (n - 1) - node_idx * (node_idx - 1) // 2 as start
        from g_basket_nodes, (select count(*) as n from g_basket_nodes)""",
    "g_basket_taken": "select start + dst - src - 1 as place from g_basket_edges join g_basket_starts on lo = src",
    "g_basket_ranks": """
        select below, max(c) as c from
        (select place - row_number() over (order by place) + 1 as below, row_number() over (order by place) as c
         from g_basket_taken) group by below""",
    "g_basket_cells": """
        select n.node_idx, month(l_shipdate)::int - 1 as dim, count(*)::double as x
        from lineitem join g_basket_nodes n on n.item_id = l_partkey group by all""",
    "g_basket_sym": "select src, dst from g_basket_edges union all select dst, src from g_basket_edges",
    "g_basket_coef": """
        select l.src, l.dst, 1.0 / sqrt(a.degree * b.degree) as w
        from (select src, dst from g_basket_sym union all select node_idx, node_idx from g_basket_nodes) l
        join (select node_idx, 1 + count(s.dst) as degree from g_basket_nodes left join g_basket_sym s on s.dst = node_idx
              group by 1) a on a.node_idx = l.src
        join (select node_idx, 1 + count(s.dst) as degree from g_basket_nodes left join g_basket_sym s on s.dst = node_idx
              group by 1) b on b.node_idx = l.dst""",
    "g_basket_hop1": """
        select c.dst as node_idx, x.dim, sum(c.w * x.x) as x from g_basket_coef c
        join g_basket_cells x on x.node_idx = c.src group by all""",
    "g_basket_hop2": """
        select c.dst as node_idx, x.dim, sum(c.w * x.x) as x from g_basket_coef c
        join g_basket_hop1 x on x.node_idx = c.src group by all""",
    "g_classes": """
        select vec_id as row_id, cast(embedding as double[]) as scores, label as target,
               vec_id % 4 <> 0 as mask from embeddings""",
    "g_features": """
        select n.node_idx, n.item_id, coalesce(v.vector, list_transform(range(64), lambda i: 0.0::double)) as vector
        from g_nidx n left join g_vectors v on v.item_id = n.item_id""",
    "g_cells": """
        select node_idx, unnest(range(64)) as dim, unnest(vector) as x from g_features""",
    "g_loops": """
        select src, dst from g_sym union all select node_idx, node_idx from g_nidx""",
    "g_degree": "select dst as node_idx, count(*) as degree from g_loops group by all",
    "g_coef": """
        select l.src, l.dst, 1.0 / sqrt(a.degree * b.degree) as w from g_loops l
        join g_degree a on a.node_idx = l.src join g_degree b on b.node_idx = l.dst""",
    "g_hop1": """
        select c.dst as node_idx, x.dim, sum(c.w * x.x) as x from g_coef c join g_cells x on x.node_idx = c.src
        group by all""",
    "g_hop2": """
        select c.dst as node_idx, x.dim, sum(c.w * x.x) as x from g_coef c join g_hop1 x on x.node_idx = c.src
        group by all""",
}

_NAME = re.compile(r"\bg_[a-z0-9_]+\b")


def with_views(sql: str) -> str:
    """`sql` with a WITH clause for the views it uses, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    clauses = ",\n".join(f"{name} as materialized ({VIEWS[name].strip()})" for name in order)
    return f"with {clauses}\n{sql.strip()}"
