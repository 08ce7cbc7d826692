"""Registered queries: candidate labels, reference rankings, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.functions.draws import draw_sql
from sessiongraph.operators import coview, index, labels, rankings, sampling
from sessiongraph.plans.registry import Run, query

_LABEL = "split, execution_id, trigger_id, item_id"


@query(
    "f1_explode_candidates",
    """select execution_id, cast(placement_pos as int) as placement_pos, cast(candidate_pos + 1 as int) as rank,
              item_id from g_candidates where candidate_pos < 12""",
)
def _(c: Run) -> DataFrame:
    return labels.explode_candidates(c.logs)


@query("f2_positive_pairs", f"select {_LABEL} from g_positives")
def _(c: Run) -> DataFrame:
    return labels.positive_pairs(c.labels)


@query(
    "f3_production_mrr",
    """select split, count(*) as executions, count(best) as matched,
              round(coalesce(avg(1.0 / best), 0), 6) as mrr_matched_only,
              round(coalesce(sum(1.0 / best), 0) / count(*), 6) as mrr_coverage_adjusted,
              round(count(best) / count(*), 6) as coverage
       from (select split, execution_id, min(best_positive_rank) as best from g_labels group by all)
       group by split""",
)
def _(c: Run) -> DataFrame:
    return labels.production_mrr(c.labels)


@query("f4_all_candidates", f"select {_LABEL}, cast(rank as int) as rank from g_labels")
def _(c: Run) -> DataFrame:
    made = labels.label_candidates(c.triggers, c.logs, c.items)
    return made.select("split", "execution_id", "trigger_id", "item_id", "rank")


@query(
    "t4_mrr_without_trigger",
    """select split, count(*) as executions, count(best) as matched,
              coalesce(sum(1.0 / best) / nullif(count(best), 0), 0.0) as mrr_matched_only,
              coalesce(sum(1.0 / best), 0.0) / count(*) as mrr_coverage_adjusted,
              count(best) / count(*) as coverage
       from (select t.split, t.execution_id, min(c.place) filter (where s.item_id is not null) as best
             from g_triggers t
             join (select c.execution_id, c.item_id, row_number() over
                     (partition by c.execution_id, c.placement_pos order by c.candidate_pos) as place
                   from g_candidates c join g_logs l on l.execution_id = c.execution_id
                   where c.item_id <> l.item_id) c on c.execution_id = t.execution_id and c.place <= 12
             left join g_items s on s.split = t.split and s.user_id = t.user_id and s.session_id = t.session_id
                  and s.item_id = c.item_id
             group by all) group by split""",
)
def _(c: Run) -> DataFrame:
    offered = labels.without_trigger(c.logs)
    return labels.production_mrr(labels.label_candidates(c.triggers, offered, c.items, c.settings.top_k))


@query(
    "t11_known_positives",
    """select split, count(*) as positives, count(k.item_a) as known, count(k.item_a) / count(*) as known_share
       from g_positives p left join g_known k on k.item_a = p.trigger_id and k.item_b = p.item_id group by split""",
)
def _(c: Run) -> DataFrame:
    return labels.known_positives(c.labels, c.train_edges)


@query(
    "t12_positives_after_log",
    """select o.split, o.execution_id, o.trigger_id, o.item_id, min(o.rank) as best_positive_rank
       from g_offered o join g_logs l on l.execution_id = o.execution_id
       where o.seen and exists (select 1 from g_sv v where v.split = o.split and v.user_id = o.user_id
             and v.session_id = o.session_id and v.item_id = o.item_id and v.emitted > l.log_instant)
       group by all""",
)
def _(c: Run) -> DataFrame:
    seen = coview.last_views(c.session_views)
    found = labels.label_candidates(c.triggers, c.logs, seen, c.settings.top_k, after_log_only=True)
    return found.where("is_positive").select(*labels.LABEL_KEY, "best_positive_rank")


@query("f5_known_pairs", "select item_a, item_b from g_known")
def _(c: Run) -> DataFrame:
    return labels.known_pairs(c.train_edges)


@query("f6_unknown_candidates", f"select {_LABEL}, cast(rank as int) as rank from g_unknown")
def _(c: Run) -> DataFrame:
    rows = labels.unknown_candidates(c.labels, c.train_edges)
    return rows.select("split", "execution_id", "trigger_id", "item_id", "rank")


@query("f7_negative_candidates", f"select {_LABEL}, cast(rank as int) as rank from g_negatives")
def _(c: Run) -> DataFrame:
    rows = labels.negative_candidates(c.labels, c.train_edges)
    return rows.select("split", "execution_id", "trigger_id", "item_id", "rank")


@query("f8_negatives_above_deepest", f"select {_LABEL}, cast(rank as int) as rank from g_kept")
def _(c: Run) -> DataFrame:
    return labels.negatives_above_deepest(labels.negative_candidates(c.labels, c.train_edges), c.labels)


_PURE = f"""select {_LABEL}, cast(rank as int) as rank from g_negatives n where not exists
            (select 1 from g_positives p where p.split = n.split and p.execution_id = n.execution_id)"""


@query("f9_negatives_without_positive", _PURE)
def _(c: Run) -> DataFrame:
    negatives = labels.negative_candidates(c.labels, c.train_edges)
    return labels.negatives_without_positive(negatives, c.labels, fraction=1.0)


@query(
    "f9_negatives_without_positive_sampled",
    f"select * from ({_PURE}) where {draw_sql('execution_id', seed=42)} % 1000000 < 250000",
)
def _(c: Run) -> DataFrame:
    negatives = labels.negative_candidates(c.labels, c.train_edges)
    return labels.negatives_without_positive(negatives, c.labels, fraction=0.25)


@query("f10_training_negatives", f"select {_LABEL}, cast(rank as int) as rank from g_kept union all {_PURE}")
def _(c: Run) -> DataFrame:
    return labels.training_negatives(c.labels, c.train_edges, pure_fraction=1.0)


@query("f11_execution_codes", "select split, execution_id, exec_code from g_codes")
def _(c: Run) -> DataFrame:
    return labels.execution_codes(c.triggers)


@query("f12_encode_pairs", "select split, exec_code, src, dst, is_positive from g_pairs")
def _(c: Run) -> DataFrame:
    both = labels.labelled_pairs(c.positives, c.negatives)
    return labels.encode_pairs(both, c.codes, c.node_index)


@query("g1_distinct_triggers", "select split, user_id, session_id, execution_id, trigger_id from g_triggers")
def _(c: Run) -> DataFrame:
    return labels.distinct_triggers(c.matched)


@query(
    "g2_trigger_session_views",
    """select t.split, t.user_id, t.session_id, t.execution_id, t.trigger_id, s.item_id, s.emitted
       from g_triggers t join g_sv s on s.split = t.split and s.user_id = t.user_id
       and s.session_id = t.session_id""",
)
def _(c: Run) -> DataFrame:
    rows = rankings.trigger_session_views(c.triggers, c.session_views)
    return rows.select("split", "user_id", "session_id", "execution_id", "trigger_id", "item_id", "emitted")


@query(
    "g3_sessions_raw",
    """select t.split, c.exec_code, t.trigger_id, t.execution_id, t.session_id, s.item_id, s.emitted
       from g_triggers t join g_codes c on c.split = t.split and c.execution_id = t.execution_id
       join g_sv s on s.split = t.split and s.user_id = t.user_id and s.session_id = t.session_id""",
)
def _(c: Run) -> DataFrame:
    rows = rankings.sessions_raw(c.triggers, c.session_views, c.codes)
    return rows.select("split", "exec_code", "trigger_id", "execution_id", "session_id", "item_id", "emitted")


@query(
    "g4_placements",
    """select t.split, t.execution_id, t.trigger_id, cast(p.placement_pos as int) as placement_pos,
              p.n as n_candidates
       from (select split, execution_id, min(trigger_id) as trigger_id from g_triggers group by all) t
       join (select execution_id, placement_pos, count(*) as n from g_candidates group by all) p
            on p.execution_id = t.execution_id""",
)
def _(c: Run) -> DataFrame:
    rows = rankings.placements(c.triggers, c.logs)
    return rows.withColumn("n_candidates", F.size("candidates").cast("long")).drop("candidates")


@query(
    "g5_relevance_order",
    """select execution_id, cast(placement_pos as int) as placement_pos, item_id,
              cast(row_number() over (partition by execution_id, placement_pos
                                 order by score desc nulls last, item_id) as int) as pos
       from g_candidates""",
)
def _(c: Run) -> DataFrame:
    placed = c.logs.select("execution_id", F.posexplode("placements").alias("placement_pos", "placement"))
    ordered = placed.select(
        "execution_id",
        "placement_pos",
        F.posexplode(rankings.by_relevance(F.col("placement.candidates"))).alias("pos", "item_id"),
    )
    return ordered.withColumn("pos", F.col("pos") + 1)


@query(
    "g6_merged_rankings",
    "select execution_id, variant, item_id, cast(rank as int) as rank from g_lists",
)
def _(c: Run) -> DataFrame:
    lists = rankings.ranked_lists(c.logs)
    parts = [
        lists.select("execution_id", F.lit(v).alias("variant"), F.posexplode(v).alias("pos", "item_id"))
        for v in rankings.VARIANTS
    ]
    both = parts[0].unionByName(parts[1])
    return both.select("execution_id", "variant", "item_id", (F.col("pos") + 1).alias("rank"))


_PROD = "select split, exec_code, trigger_id, execution_id, variant, cast(rank as int) as rank, item_id, seen from g_prod"


@query("g7_seen_split", _PROD)
def _(c: Run) -> DataFrame:
    rows = rankings.prod_rankings(c.owners, c.logs, c.items, listed=c.listed)
    return rows.select("split", "exec_code", "trigger_id", "execution_id", "variant", "rank", "item_id", "seen")


@query(
    "g8_prod_results",
    """select split, exec_code, trigger_id, execution_id, 'products_returned_' || variant as list,
              cast(rank as int) as rank, item_id from g_prod
       union all
       select split, exec_code, trigger_id, execution_id,
              case when seen then 'positives_' else 'negatives_' end || variant, cast(rank as int), item_id
       from g_prod""",
)
def _(c: Run) -> DataFrame:
    names = [f"{name}_{v}" for name in ("products_returned", "positives", "negatives") for v in rankings.VARIANTS]
    lists = F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("products")) for n in names])
    keys = ["split", "exec_code", "trigger_id", "execution_id"]
    return c.prod.select(*keys, F.inline(lists)).select(*keys, "list", F.inline("products")).select(
        *keys, "list", "rank", "item_id"
    )


@query(
    "g9_list_mrr",
    """select split, variant, count(*) as total, count(best) as matched,
              round(coalesce(avg(1.0 / best), 0), 6) as mrr_matched_only,
              round(coalesce(sum(1.0 / best), 0) / count(*), 6) as mrr_coverage_adjusted
       from (select o.split, a.variant, o.exec_code, min(p.rank) as best from g_owners o
             cross join (values ('display'), ('relevance')) a(variant)
             left join g_prod p on p.split = o.split and p.exec_code = o.exec_code and p.variant = a.variant
                  and p.seen group by all) group by split, variant""",
)
def _(c: Run) -> DataFrame:
    parts = [
        rankings.list_mrr(c.prod, f"positives_{v}").withColumn("variant", F.lit(v)) for v in rankings.VARIANTS
    ]
    return parts[0].unionByName(parts[1])


@query(
    "g10_variant_diagnostics",
    """select d.split, count(*) as total_triggers, round(avg(d.n), 6) as avg_n_display,
              round(avg(coalesce(o.n, 0)), 6) as avg_overlap,
              round(avg((coalesce(o.n, 0) = d.n and d.n = r.n)::int), 6) as pct_identical_sets,
              round(avg(d.pos), 6) as avg_pos_display, round(avg(r.pos), 6) as avg_pos_relevance,
              round(avg((d.pos > 0)::int), 6) as pct_found_display,
              round(avg((r.pos > 0)::int), 6) as pct_found_relevance
       from (select split, exec_code, count(*) as n, count(*) filter (where seen) as pos
             from g_prod where variant = 'display' group by all) d
       join (select split, exec_code, count(*) as n, count(*) filter (where seen) as pos
             from g_prod where variant = 'relevance' group by all) r
            on r.split = d.split and r.exec_code = d.exec_code
       left join (select a.split, a.exec_code, count(*) as n from g_prod a join g_prod b
                  on a.split = b.split and a.exec_code = b.exec_code and a.item_id = b.item_id
                  and a.variant = 'display' and b.variant = 'relevance' group by all) o
            on o.split = d.split and o.exec_code = d.exec_code group by d.split""",
)
def _(c: Run) -> DataFrame:
    return rankings.variant_diagnostics(c.prod)


@query(
    "k1_cap_negatives",
    f"""select {_LABEL}, cast(rank as int) as rank from
        (select n.*, q.quota, row_number() over (partition by n.split, n.execution_id
                                                 order by n.rank, n.item_id, n.trigger_id) as place
         from g_kept n join (select split, execution_id, count(*) * 2 as quota from g_positives group by all) q
              on q.split = n.split and q.execution_id = n.execution_id) where place <= quota""",
)
def _(c: Run) -> DataFrame:
    return sampling.cap_negatives(
        c.positives, c.negatives, ["split", "execution_id"], ["rank", "item_id", "trigger_id"], ratio=2
    )


def _train_pairs(c: Run, positive: bool) -> DataFrame:
    chosen = (F.col("split") == "train") & (F.col("is_positive") == F.lit(positive))
    return c.pairs.where(chosen).select("exec_code", "src", "dst")


@query(
    "k2_epoch_sample",
    f"""select exec_code, src, dst, label,
               row_number() over (order by {draw_sql('exec_code', 'src', 'dst', 'label', seed=43)},
                                  exec_code, src, dst, label) - 1 as position
        from (select exec_code, src, dst, cast(1.0 as double) as label from g_pairs where split = 'train' and is_positive
              union all
              select exec_code, src, dst, cast(0.0 as double) from
              (select *, row_number() over (order by {draw_sql('exec_code', 'src', 'dst', seed=42)},
                                            exec_code, src, dst) as place
               from g_pairs where split = 'train' and not is_positive)
              where place <= 2 * (select count(*) from g_pairs where split = 'train' and is_positive))""",
)
def _(c: Run) -> DataFrame:
    return sampling.epoch_sample(_train_pairs(c, True), _train_pairs(c, False), ratio=2)


@query(
    "k3_random_non_edges",
    f"""select for_src, for_dst, case when ahead then lo else place - start + lo + 1 end as src,
               case when ahead then place - start + lo + 1 else lo end as dst
        from (select a.*, t + coalesce(c, 0) as place
              from (select src as for_src, dst as for_dst, {draw_sql('src', 'dst', seed=43)} % 2 = 0 as ahead,
                           {draw_sql('src', 'dst', seed=42)}
                           % (n * (n - 1) // 2 - (select count(*) from g_basket_taken)) as t
                    from g_basket_edges, (select count(*) as n from g_basket_nodes)) a
              asof left join g_basket_ranks r on a.t >= r.below) p
        asof join g_basket_starts s on p.place >= s.start""",
)
def _(c: Run) -> DataFrame:
    edges = c.basket_edges.select("src", "dst")
    return sampling.random_non_edges(edges, c.basket_nodes, edges)


@query(
    "k4_draw_stored_negatives",
    f"""select for_exec_code, for_src, for_dst, draw, src, dst from
        (select distinct exec_code as for_exec_code, src as for_src, dst as for_dst from g_pairs
         where split = 'train' and is_positive) cross join (select unnest(range(1, 6)) as draw)
        join (select src, dst, row_number() over (order by src, dst) - 1 as number, count(*) over () as n
              from g_pairs where split = 'train' and not is_positive)
             on number = {draw_sql('for_exec_code', 'for_src', 'for_dst', 'draw', seed=42)} % n""",
)
def _(c: Run) -> DataFrame:
    return sampling.draw_stored_negatives(_train_pairs(c, True).distinct(), _train_pairs(c, False))


@query(
    "k4_aligned_negatives",
    """select p.src as for_src, p.dst as for_dst, n.src, n.dst, p.number from
       (select src, dst, row_number() over (order by src, dst) - 1 as number from g_pairs
        where split = 'train' and is_positive) p join
       (select src, dst, row_number() over (order by src, dst) - 1 as number from g_pairs
        where split = 'train' and not is_positive) n on n.number = p.number""",
)
def _(c: Run) -> DataFrame:
    return sampling.aligned_negatives(_train_pairs(c, True), _train_pairs(c, False))


@query(
    "k5_labelled_union",
    "select split, exec_code, src, dst, is_positive::int::double as label from g_pairs where split <> 'train'",
)
def _(c: Run) -> DataFrame:
    held = c.pairs.where(F.col("split") != "train")
    keys = ["split", "exec_code", "src", "dst"]
    return sampling.labelled_union(
        held.where("is_positive").select(*keys), held.where(~F.col("is_positive")).select(*keys)
    )


@query(
    "k6_batch_ids",
    """select row_idx // 8192 as batch_id, group_id, cast(label as int) as label, score, line_no, item_id, row_idx
       from (select *, row_number() over (order by label desc, group_id, line_no, item_id, score) - 1 as row_idx
             from g_scores)""",
)
def _(c: Run) -> DataFrame:
    order = [F.col("label").desc(), *[F.col(n) for n in ("group_id", "line_no", "item_id", "score")]]
    return index.batch_ids(c.scores, order, 8192)


@query("k6_batch_count", "select cast(greatest(ceil(count(*) / 8192.0), 1) as bigint) as n_batches from g_scores")
def _(c: Run) -> DataFrame:
    return index.batch_count(c.scores, 8192)
