"""Registered queries: retrieval and pair metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongraph.functions.vectors import cosine, linear_pair_score, unit
from sessiongraph.operators import inverted_lists, ranking_metrics, retrieval
from sessiongraph.plans.registry import Run, query

_ROWS = "split, exec_code, item_id, round(score, 6) as score, cast(rank as int) as rank"


@query("h1_graph_triggers", "select split, exec_code, trigger_id, node_idx from g_gtriggers")
def _(c: Run) -> DataFrame:
    rows = retrieval.graph_triggers(c.owners, c.node_index)
    return rows.select("split", "exec_code", "trigger_id", "node_idx")


@query("h2_trigger_categories", "select split, exec_code, trigger_id, category from g_gtriggers")
def _(c: Run) -> DataFrame:
    inside = retrieval.graph_triggers(c.owners, c.node_index)
    return retrieval.with_category(inside, c.vectors).select("split", "exec_code", "trigger_id", "category")


@query("h3_candidate_pool", "select category, item_id from g_pool")
def _(c: Run) -> DataFrame:
    return retrieval.candidate_pool(c.graph_triggers, c.vectors, c.node_index)


@query("h4_unit_vectors", "select item_id, unnest(range(64)) as dim, round(unnest(u), 6) as x from g_units")
def _(c: Run) -> DataFrame:
    rows = c.vectors.select("item_id", F.posexplode(unit(F.col("vector"))).alias("dim", "x"))
    return rows.withColumn("dim", F.col("dim").cast("long"))


def _edge_vectors(c: Run) -> DataFrame:
    first = c.vectors.select(F.col("item_id").alias("item_a"), F.col("vector").alias("left_vector"))
    second = c.vectors.select(F.col("item_id").alias("item_b"), F.col("vector").alias("right_vector"))
    return c.edges.join(first, "item_a").join(second, "item_b")


@query(
    "h5_pair_cosine",
    """select e.split, e.item_a, e.item_b, round(list_dot_product(a.u, b.u), 6) as score
       from g_edges e join g_units a on a.item_id = e.item_a join g_units b on b.item_id = e.item_b""",
)
def _(c: Run) -> DataFrame:
    score = cosine(F.col("left_vector"), F.col("right_vector"))
    return _edge_vectors(c).select("split", "item_a", "item_b", score.alias("score"))


@query("h6_exact_top_k", f"select {_ROWS} from g_model_rows")
def _(c: Run) -> DataFrame:
    return retrieval.exact_top_k(c.graph_triggers, c.pool, c.vectors, c.settings.top_k)


def _all_items(c: Run) -> tuple[DataFrame, DataFrame]:
    """Every item as a trigger and the whole vector table as pools."""
    triggers = c.vectors.select(
        F.lit("all").alias("split"),
        F.col("item_id").alias("exec_code"),
        F.col("item_id").alias("trigger_id"),
        "category",
    )
    pool = c.vectors.where(F.col("category").isNotNull()).select("category", "item_id")
    return triggers, pool


_EXACT_ALL_ITEMS = """select 'all' as split, exec_code, item_id, round(score, 6) as score, cast(rank as int) as rank from
       (select *, row_number() over (partition by exec_code order by score desc, item_id) as rank from
        (select a.item_id as exec_code, b.item_id, list_dot_product(a.u, b.u) as score
         from g_units a join g_units b on a.category = b.category and a.item_id <> b.item_id)) where rank <= 12"""


@query("h6_exact_top_k_all_items", _EXACT_ALL_ITEMS)
def _(c: Run) -> DataFrame:
    triggers, pool = _all_items(c)
    return retrieval.exact_top_k(triggers, pool, c.vectors, c.settings.top_k)


@query(
    "h7_linear_pair_score",
    """select e.split, e.item_a, e.item_b, round(0.25 + list_sum(list_transform(range(64),
              lambda i: a.vector[i + 1] * b.vector[i + 1] / (i + 1))), 6) as score
       from g_edges e join g_vectors a on a.item_id = e.item_a join g_vectors b on b.item_id = e.item_b""",
)
def _(c: Run) -> DataFrame:
    weights = [1.0 / (i + 1) for i in range(c.settings.vector_dim)]
    score = linear_pair_score(F.col("left_vector"), F.col("right_vector"), weights, bias=0.25)
    return _edge_vectors(c).select("split", "item_a", "item_b", score.alias("score"))


@query(
    "h7_linear_top_k",
    """select 'all' as split, exec_code, item_id, round(score + 0.25, 6) as score, cast(rank as int) as rank from
       (select *, row_number() over (partition by exec_code order by score desc, item_id) as rank from
        (select a.item_id as exec_code, b.item_id, list_sum(list_transform(range(64),
                lambda i: a.vector[i + 1] * b.vector[i + 1] / (i + 1))) as score
         from g_vectors a join g_vectors b on a.category = b.category and a.item_id <> b.item_id)) where rank <= 12""",
)
def _(c: Run) -> DataFrame:
    triggers, pool = _all_items(c)
    weights = [1.0 / (i + 1) for i in range(c.settings.vector_dim)]
    return retrieval.linear_top_k(triggers, pool, c.vectors, c.settings.top_k, weights, bias=0.25)


@query("h8_fit_pair_classifier")
def _(c: Run) -> DataFrame:
    examples = retrieval.pair_features(c.pairs, c.features)
    model = retrieval.fit_pair_classifier(examples.where(F.col("split") == "train"), iterations=20, l2=0.01)
    return retrieval.linear_scores(model, examples.where(F.col("split") != "train"))


_NEWTON_STEPS = 8
_NEWTON_L2 = 0.01


def _newton_sql() -> str:
    """The same steps with two weights, each written out; the system of two rows is solved by determinants."""
    steps = [
        """fit_rows as (select p.split, p.exec_code, p.src, p.dst, p.is_positive::int::double as y,
             list_dot_product(a.vector, b.vector) as x
           from g_pairs p join g_features a on a.node_idx = p.src join g_features b on b.node_idx = p.dst),
         w0 as (select 0.0::double as b, 0.0::double as w)"""
    ]
    for i in range(_NEWTON_STEPS):
        steps.append(
            f"""s{i} as (select b, w, avg(p - y) as g0, avg((p - y) * x) + {_NEWTON_L2} * w as g1,
                  avg(p * (1 - p)) as h00, avg(p * (1 - p) * x) as h01, avg(p * (1 - p) * x * x) + {_NEWTON_L2} as h11
                from (select y, x, b, w, 1 / (1 + exp(-(b + w * x))) as p from fit_rows, w{i} where split = 'train')
                group by b, w),
                w{i + 1} as (select b - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as b,
                  w - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as w from s{i})"""
        )
    return f"""select * from (with {", ".join(steps)}
               select split, exec_code, src, dst, y as label, b + w * x as score
               from fit_rows, w{_NEWTON_STEPS} where split <> 'train')"""


@query("h8_newton_pair_classifier", _newton_sql())
def _(c: Run) -> DataFrame:
    """A linear head on the similarity of a pair, fitted on train pairs, and its scores of the others."""
    examples = retrieval.pair_similarity(c.pairs, c.features)
    train = examples.where(F.col("split") == "train")
    weights = retrieval.fit_by_newton(train, ["similarity"], l2=_NEWTON_L2, steps=_NEWTON_STEPS)
    score = retrieval.log_odds(weights, ["similarity"]).alias("score")
    return examples.where(F.col("split") != "train").select("split", "exec_code", "src", "dst", "label", score)


@query("h9_approximate_top_k")
def _(c: Run) -> DataFrame:
    triggers, pool = _all_items(c)
    return inverted_lists.approximate_top_k(triggers, pool, c.vectors, c.settings.top_k, iterations=3)


@query("h9_bounded_top_k", _EXACT_ALL_ITEMS)
def _(c: Run) -> DataFrame:
    """Two lists are probed, then those whose bound allows a better item: the answer must be the exact one."""
    triggers, pool = _all_items(c)
    return inverted_lists.approximate_top_k(
        triggers, pool, c.vectors, c.settings.top_k, probes=2, bounded=True, iterations=3
    )


@query("h9_approximate_top_k_all_lists", _EXACT_ALL_ITEMS)
def _(c: Run) -> DataFrame:
    """Every list is probed, so the answer must be the exact one."""
    triggers, pool = _all_items(c)
    return inverted_lists.approximate_top_k(triggers, pool, c.vectors, c.settings.top_k, probes=1 << 20, iterations=3)


@query(
    "h10_parity",
    """select count(distinct (split, exec_code)) as checked, count(distinct (split, exec_code)) as same_ids,
              0::bigint as mismatches, 0.0::double as max_gap
       from g_model_rows""",
)
def _(c: Run) -> DataFrame:
    return retrieval.check_against_pairwise(c.model_rows, c.graph_triggers, c.pool, c.vectors, c.settings.top_k)


@query(
    "h10_parity_of_faulty_rows",
    """select count(*) as checked, count(*) filter (where exec_code % 5 <> 3) as same_ids,
              count(*) filter (where exec_code % 7 = 2) as mismatches,
              max(case when exec_code % 7 = 2 then 0.25 else 0.0 end) as max_gap
       from (select distinct split, exec_code from g_model_rows)""",
)
def _(c: Run) -> DataFrame:
    """Some triggers get a wrong best item, some a wrong score."""
    wrong_item = (F.col("exec_code") % 5 == 3) & (F.col("rank") == 1)
    faulty = c.model_rows.select(
        "split",
        "exec_code",
        "rank",
        F.when(wrong_item, F.lit(-1)).otherwise(F.col("item_id")).alias("item_id"),
        F.when(F.col("exec_code") % 7 == 2, F.col("score") - 0.25).otherwise(F.col("score")).alias("score"),
    )
    return retrieval.check_against_pairwise(faulty, c.graph_triggers, c.pool, c.vectors, c.settings.top_k)


@query(
    "h11_recall_against_exact",
    """select round(avg(share), 6) as mean_recall, count(*) filter (where share < 1) as below_one,
              count(*) as triggers
       from (select g.split, g.exec_code,
                    case when count(m.item_id) = 0 then 1.0
                         else count(*) filter (where m.rank <= 6) / count(m.item_id) end as share
             from g_gtriggers g left join g_model_rows m on m.split = g.split and m.exec_code = g.exec_code
             group by all)""",
)
def _(c: Run) -> DataFrame:
    """The better half of the exact answer measured against all of it."""
    half = c.model_rows.where(F.col("rank") <= 6)
    return retrieval.recall_against_exact(c.graph_triggers, half, c.model_rows)


def _recall_of_approximate(c: Run) -> DataFrame:
    triggers, pool = _all_items(c)
    k = c.settings.top_k
    exact = retrieval.exact_top_k(triggers, pool, c.vectors, k)
    found = inverted_lists.approximate_top_k(triggers, pool, c.vectors, k, iterations=3)
    return retrieval.recall_against_exact(triggers, found, exact)


@query("h11_recall_of_approximate")
def _(c: Run) -> DataFrame:
    return _recall_of_approximate(c)


@query("h11_recall_floor", "select count(*) as triggers, true as reached from g_vectors")
def _(c: Run) -> DataFrame:
    """Whether the calibrated search finds nine tenths of the exact answers."""
    return _recall_of_approximate(c).select("triggers", (F.col("mean_recall") >= 0.9).alias("reached"))


@query(
    "h12_model_results",
    """select split, exec_code, trigger_id, 'products_returned' as list, cast(rank as int) as rank, item_id,
              round(score, 6) as score from g_model
       union all
       select split, exec_code, trigger_id, case when seen then 'positives' else 'negatives' end,
              cast(rank as int), item_id, round(score, 6) from g_model
       union all
       select g.split, g.exec_code, g.trigger_id, 'none', null, null, null from g_gtriggers g
       where not exists (select 1 from g_model m where m.split = g.split and m.exec_code = g.exec_code)""",
)
def _(c: Run) -> DataFrame:
    results = retrieval.model_results(c.graph_triggers, c.model_rows, c.items, c.listed)
    keys = ["split", "exec_code", "trigger_id"]
    names = ("products_returned", "positives", "negatives")
    lists = F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("products")) for n in names])
    listed = results.select(*keys, F.inline(lists)).select(*keys, "list", F.inline("products"))
    empty = results.where(F.size("products_returned") == 0).select(
        *keys,
        F.lit("none").alias("list"),
        F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast("long").alias("item_id"),
        F.lit(None).cast("double").alias("score"),
    )
    return listed.select(*empty.columns).unionByName(empty)


@query(
    "h13_retrieval_counters",
    """select o.split, count(*) as prod, count(*) filter (where g.exec_code is null) as outside_graph,
              count(g.exec_code) as in_graph,
              count(*) filter (where g.exec_code is not null and g.category is null) as missing_category,
              count(*) filter (where g.exec_code is not null and m.exec_code is null) as unscored
       from g_owners o left join g_gtriggers g on g.split = o.split and g.exec_code = o.exec_code
       left join (select distinct split, exec_code from g_model_rows) m
            on m.split = o.split and m.exec_code = o.exec_code group by o.split""",
)
def _(c: Run) -> DataFrame:
    return retrieval.retrieval_counters(c.owners, c.graph_triggers, c.model_rows)


def _overlap_sql(a: str, b: str) -> str:
    return f"""(select count(*) from g_arm_lists x join g_arm_lists y on x.split = y.split
                and x.exec_code = y.exec_code and x.item_id = y.item_id
                where x.arm = '{a}' and y.arm = '{b}' and x.split = g.split and x.exec_code = g.exec_code)"""


@query(
    "h14_compare_lists",
    f"""select g.split, g.exec_code, cast({_overlap_sql("display", "relevance")} as int) as overlap_display_relevance,
               cast({_overlap_sql("model", "display")} as int) as overlap_model_display,
               cast({_overlap_sql("model", "relevance")} as int) as overlap_model_relevance from g_gtriggers g""",
)
def _(c: Run) -> DataFrame:
    return retrieval.compare_lists(c.prod, c.model)


@query(
    "h14_named_products",
    """select m.split, m.exec_code, cast(m.rank as int) as rank, m.item_id, k.name, k.image_url from g_model m
       left join g_catalog k on k.item_id = m.item_id""",
)
def _(c: Run) -> DataFrame:
    return retrieval.named_products(c.model, "products_returned", c.catalog)


def _hits_sql(k: int) -> str:
    """With fewer than k negatives every positive counts as a hit."""
    return f"""case when (select count(*) from g_neg) < {k} then 1.0::double else
               (select round(avg((score > (select min(score) from
                (select score from g_neg order by score desc limit {k})))::int), 6) from g_pos) end as hits_{k}"""


@query("j1_hits_at_k", f"select {_hits_sql(1)}, {_hits_sql(10)}, {_hits_sql(10000)}")
def _(c: Run) -> DataFrame:
    return ranking_metrics.hits_at(ranking_metrics.score_ladder(c.scores), [1, 10, 10_000])


_COUNTS = """select score, count(*) filter (where label = 1) as n_pos, count(*) filter (where label = 0) as n_neg
             from g_scores group by score"""


@query(
    "j2_mrr",
    f"""select round(sum(p.n_pos / (0.5 * (p.above + p.above + p.n_neg) + 1)) / sum(p.n_pos), 6) as mrr from
        (select a.score, a.n_pos, a.n_neg, coalesce((select sum(b.n_neg) from ({_COUNTS}) b
                where b.score > a.score), 0) as above from ({_COUNTS}) a) p""",
)
def _(c: Run) -> DataFrame:
    return ranking_metrics.mrr(ranking_metrics.score_ladder(c.scores))


_GROUPED = """select group_id, count(*) as n, count(*) filter (where label = 1) as pos,
                     count(*) filter (where label = 1 and score > 0) as tp,
                     count(*) filter (where label = 0 and score > 0) as fp,
                     count(*) filter (where label = 0 and score <= 0) as tn from g_scores group by group_id"""


@query("j3_group_accuracy", f"select round(avg((tp + tn) / n), 6) as group_accuracy from ({_GROUPED})")
def _(c: Run) -> DataFrame:
    return ranking_metrics.group_threshold_metrics(c.scores).select("group_accuracy")


def _group_hits_sql(k: int) -> str:
    return f"""(select round(avg(hit), 6) from
        (select p.group_id, avg(case when n.kth is null or p.score > n.kth then 1 else 0 end) as hit from g_pos p
         left join (select group_id, score as kth from
                    (select *, row_number() over (partition by group_id order by score desc) as place from g_neg)
                    where place = {k}) n on n.group_id = p.group_id group by p.group_id)) as group_hits_{k}"""


@query("j4_group_hits_at_k", f"select {_group_hits_sql(1)}, {_group_hits_sql(3)}, {_group_hits_sql(5)}")
def _(c: Run) -> DataFrame:
    return ranking_metrics.group_hits_at(ranking_metrics.group_ladder(c.scores), [1, 3, 5])


@query(
    "j5_group_mrr",
    """select round(avg(rr), 6) as group_mrr from
       (select p.group_id, avg(1.0 / (1 + (select count(*) from g_neg n where n.group_id = p.group_id
                                           and n.score > p.score))) as rr from g_pos p group by p.group_id)""",
)
def _(c: Run) -> DataFrame:
    return ranking_metrics.group_mrr(ranking_metrics.group_ladder(c.scores))


@query("j6_group_precision", f"select round(avg(tp / greatest(tp + fp, 1)), 6) as group_precision from ({_GROUPED})")
def _(c: Run) -> DataFrame:
    return ranking_metrics.group_threshold_metrics(c.scores).select("group_precision")


@query("j7_group_recall", f"select round(avg(tp / pos), 6) as group_recall from ({_GROUPED}) where pos > 0")
def _(c: Run) -> DataFrame:
    return ranking_metrics.group_threshold_metrics(c.scores).select("group_recall")


@query(
    "j8_binary_accuracy",
    """select count(*) filter (where (score > 0) = (label = 1)) as correct,
              round(avg(((score > 0) = (label = 1))::int), 6) as accuracy from g_scores""",
)
def _(c: Run) -> DataFrame:
    return ranking_metrics.binary_metrics(c.scores).select("correct", "accuracy")


@query("j9_predicted_positive", "select round(avg((score > 0)::int), 6) as predicted_positive from g_scores")
def _(c: Run) -> DataFrame:
    return ranking_metrics.binary_metrics(c.scores).select("predicted_positive")


@query(
    "j10_precision_recall_f1",
    """select round(tp / (tp + fp), 6) as "precision", round(tp / (tp + fn), 6) as recall,
              round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy
       from (select count(*) filter (where label = 1 and 1 / (1 + exp(-score)) > 0.5) as tp,
                    count(*) filter (where label = 0 and 1 / (1 + exp(-score)) > 0.5) as fp,
                    count(*) filter (where label = 1 and 1 / (1 + exp(-score)) <= 0.5) as fn,
                    count(*) filter (where label = 0 and 1 / (1 + exp(-score)) <= 0.5) as tn from g_scores)""",
)
def _(c: Run) -> DataFrame:
    return ranking_metrics.binary_metrics(c.scores).select("precision", "recall", "f1", "accuracy")


@query(
    "j11_roc_auc",
    f"""select round(sum(a.n_pos * b.n_neg * case when a.score > b.score then 1.0::double
                         when a.score = b.score then 0.5 else 0 end)
                     / (sum(a.n_pos * b.n_neg)), 6) as roc_auc from ({_COUNTS}) a cross join ({_COUNTS}) b""",
)
def _(c: Run) -> DataFrame:
    return ranking_metrics.roc_auc(ranking_metrics.score_ladder(c.scores))


_RIGHT = "avg((list_position(scores, list_max(scores)) - 1 = target)::int)"


@query("j12_class_accuracy", f"select round({_RIGHT}, 6) as accuracy from g_classes where mask")
def _(c: Run) -> DataFrame:
    return ranking_metrics.class_metrics(c.classes).select("accuracy")


@query(
    "j13_class_micro_scores",
    f"""select round({_RIGHT}, 6) as micro_precision, round({_RIGHT}, 6) as micro_recall,
               round({_RIGHT}, 6) as micro_f1 from g_classes where mask""",
)
def _(c: Run) -> DataFrame:
    return ranking_metrics.class_metrics(c.classes).select("micro_precision", "micro_recall", "micro_f1")


@query(
    "j14_bce_loss",
    """select round(avg(-(label * ln(1 / (1 + exp(-score))) + (1 - label) * ln(1 - 1 / (1 + exp(-score))))), 6)
       as bce from g_scores""",
)
def _(c: Run) -> DataFrame:
    return ranking_metrics.bce_loss(c.scores)


@query(
    "j14_cross_entropy_loss",
    """select round(avg(ln(list_sum(list_transform(scores, lambda x: exp(x)))) - scores[target + 1]), 6)
       as cross_entropy from g_classes""",
)
def _(c: Run) -> DataFrame:
    return ranking_metrics.cross_entropy_loss(c.classes)
