"""Named queries (one per operator) and their DuckDB oracle SQL.

Every query reads the driver tables through the fixture views of
:mod:`tabula.plans.fixtures`; outputs alias every computed column so names
match the oracle. Doubles that come from sums in different orders are rounded
to 12 decimals on both sides.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.operators import candidates as cand
from tabula.operators import boosting, cleaning, folds, metrics, vocabulary, vote
from tabula.operators import learners as lrn
from tabula.operators import preprocess as pp
from tabula.plans import ensemble as ens
from tabula.plans import fixtures as fx
from tabula.plans import jobs, search, stacking
from tabula.plans import reports as rep
from tabula.session import checkpointed, scratch_path
from tabula.sources import csv as csvio
from tabula.sources import store

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Fixed parameters of the catalog queries.
K_FOLDS = 5
HEAD_FRACTION = 0.15
SAMPLE_FRACTION = 0.1
SAMPLE_SEED = 42
NULLED_PROPS = '{"k": 7}'
PATIENCE = 20
MIN_IMPROVEMENT = 0.1


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def r12(c):
    return F.round(c, 12)


def _pred_once(spark: SparkSession, sf: str) -> DataFrame:
    """``pred`` materialised once in the checkpoint folder, for queries that read
    it twice (vote weights, then the votes): one narrow write instead of
    recomputing the fold index over ``orders``."""
    return checkpointed(fx.pred(spark, sf))


def _models_weights(spark: SparkSession, sf: str, direction: str = "maximize", pred_df: DataFrame | None = None) -> dict[str, float]:
    """Weights of the rule models from their top_0 result scores (a 4-row,
    model-count-bounded table brought to the driver to build the vote plan)."""
    res = fx.results(spark, sf, pred_df).where(F.col("name").endswith("_top_0"))
    w = vote.ensemble_weights(res, direction).select("study", F.round("weight", 12).alias("weight"))
    got = {r["study"]: r["weight"] for r in w.collect()}
    return {m: got[m] for m in fx.RULE_MODELS}


WEIGHTS_SQL = """
w0 as (select study, score from results where name like '%\\_top\\_0' escape '\\'),
w as (select study, round(score / (select sum(score) from w0), 12) as weight from w0),
wp as (select max(case when study='p1' then weight end) as w1, max(case when study='p2' then weight end) as w2,
              max(case when study='p3' then weight end) as w3, max(case when study='p4' then weight end) as w4 from w)
"""


# ------------------------------------------------------------------ projections
@query("select_features", fx.oracle_ctes("train") + "select id, c_status, x_price from train")
def q_select_features(spark, sf):
    return cleaning.select_features(fx.train(spark, sf), ["c_status", "x_price"], keep=["id"])


@query("split_xy", fx.oracle_ctes("train") + "select id, x_price, x_month, c_priority, c_status from train")
def q_split_xy(spark, sf):
    x, _ = cleaning.split_xy(fx.train(spark, sf), "id", "class")
    return x


@query(
    "coerce_numeric",
    "select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, event_type from events",
)
def q_coerce_numeric(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return cleaning.coerce_numeric(ev, ["k", "event_type"])


@query(
    "head_fraction",
    fx.oracle_ctes("train")
    + f"""select id, x_price, x_month, c_priority, c_status, class from
         (select *, row_number() over (order by id) as rn from train) t
         where rn <= (select floor(count(*) * cast({HEAD_FRACTION} as double)) from train)""",
)
def q_head_fraction(spark, sf):
    return folds.head_fraction(fx.train(spark, sf), HEAD_FRACTION, ["id"])


@query(
    "split_halves",
    fx.oracle_ctes("train")
    + """select id, half from (
           select id, case when rn <= floor(n * cast(0.5 as double)) then 'head'
                           when rn > n - floor(n * cast(0.5 as double)) then 'tail' end as half
           from (select id, row_number() over (order by id) as rn, count(*) over () as n from train) t) u
         where half is not null""",
)
def q_split_halves(spark, sf):
    return folds.split_halves(fx.train(spark, sf).select("id"), ["id"])


@query(
    "sample_exact",
    f"""select o_orderkey, o_totalprice, sample_order from (
          select o_orderkey, o_totalprice,
                 cast(row_number() over (order by md5(concat('{SAMPLE_SEED}-', o_orderkey)), o_orderkey) - 1 as bigint) as sample_order
          from orders) t
        where sample_order < (select round(cast({SAMPLE_FRACTION} as double) * count(*)) from orders)""",
)
def q_sample_exact(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return folds.sample_exact(o, SAMPLE_FRACTION, "o_orderkey", seed=SAMPLE_SEED)


# ------------------------------------------------------------------ folds
@query(
    "kfold_contiguous",
    fx.oracle_ctes("train") + f"select id, cast(ntile({K_FOLDS}) over (order by id) - 1 as int) as fold from train",
)
def q_kfold_contiguous(spark, sf):
    return folds.kfold_contiguous(fx.train(spark, sf).select("id"), K_FOLDS, ["id"])


@query(
    "kfold_shuffled",
    fx.oracle_ctes("train")
    + f"select id, cast(ntile({K_FOLDS}) over (order by md5(concat('{folds.STACKING_FOLD_SEED}-', id)), id) - 1 as int) as fold from train",
)
def q_kfold_shuffled(spark, sf):
    return folds.kfold_shuffled(fx.train(spark, sf).select("id"), K_FOLDS, "id")


def _stratified_oracle(k: int) -> str:
    allocs = [
        f"(floor((s + m - 1 - {i}) / cast({k} as double)) - floor((s - 1 - {i}) / cast({k} as double)))" for i in range(k)
    ]
    cases = []
    for i in range(k):
        cum = " + ".join(allocs[: i + 1])
        cases.append(f"when j < {cum} then {i}")
    return (
        fx.oracle_ctes("train")
        + f""", t as (select id, class, row_number() over (partition by class order by id) - 1 as j from train),
        c as (select class, count(*) as m, min(id) as first_id from train group by class),
        cs as (select class, m, coalesce(sum(m) over (order by first_id rows between unbounded preceding and 1 preceding), 0) as s from c)
        select id, class, cast(case {' '.join(cases)} else {k - 1} end as int) as fold
        from t join cs using (class)"""
    )


@query("kfold_stratified", _stratified_oracle(K_FOLDS))
def q_kfold_stratified(spark, sf):
    return folds.kfold_stratified(fx.train(spark, sf).select("id", "class"), K_FOLDS, "class", ["id"])


@query(
    "fold_split_counts",
    fx.oracle_ctes("pred")
    + """select fold, count(*) as n_test, cast(sum(y) as bigint) as n_pos_test,
                (select count(*) from pred) - count(*) as n_train,
                cast((select sum(y) from pred) - sum(y) as bigint) as n_pos_train
         from pred group by fold""",
)
def q_fold_split_counts(spark, sf):
    return folds.fold_split_counts(fx.pred(spark, sf), "fold", "y")


# ------------------------------------------------------------------ cleaning
_EV = f"select event_id, nullif(props, '{NULLED_PROPS}') as props, event_type from events"


def _events_nulled(spark, sf):
    ev = fx.table(spark, sf, "events")
    return ev.select("event_id", F.when(F.col("props") == NULLED_PROPS, None).otherwise(F.col("props")).alias("props"), "event_type")


@query(
    "category_counts",
    f"with ev as ({_EV}) select 'props' as column, props as value, count(*) as count from ev where props is not null group by props",
)
def q_category_counts(spark, sf):
    return cleaning.category_counts(_events_nulled(spark, sf), "props")


@query(
    "rare_categories",
    f"""with ev as ({_EV}), c as (select props as value, count(*) as count from ev where props is not null group by props)
        select 'props' as column, value, count, cast((select sum(count) from c) as bigint) as total from c
        where count < cast(0.01 as double) * (select sum(count) from c)""",
)
def q_rare_categories(spark, sf):
    return cleaning.rare_categories(_events_nulled(spark, sf), "props")


@query(
    "clean_categorical",
    f"""with ev as ({_EV}), c as (select props as value, count(*) as count from ev where props is not null group by props),
        kept as (select value from c where count >= cast(0.01 as double) * (select sum(count) from c))
        select event_id, coalesce(kept.value, 'dna') as props, event_type from ev left join kept on ev.props = kept.value""",
)
def q_clean_categorical(spark, sf):
    return cleaning.clean_categorical(_events_nulled(spark, sf), columns=["props"])


@query(
    "clean_all_columns",
    f"""with ev as ({_EV}),
        l as (select event_id, 'props' as "column", props as value from ev
              union all select event_id, 'event_type' as "column", event_type as value from ev),
        c as (select "column", value, count(*) as count from l where value is not null group by "column", value),
        t as (select "column", sum(count) as total from c group by "column"),
        kept as (select c."column", c.value from c join t using ("column") where count >= cast(0.01 as double) * total)
        select l.event_id, l."column", l.value, coalesce(kept.value, 'dna') as cleaned
        from l left join kept on l."column" = kept."column" and l.value = kept.value""",
)
def q_clean_all_columns(spark, sf):
    return cleaning.clean_long(_events_nulled(spark, sf), "event_id", ["props", "event_type"])


_UNMAPPED = "case when x_price is null then 'unknown' else class end"


@query(
    "label_targets",
    fx.oracle_ctes("train")
    + f"select id, cast(case {_UNMAPPED} when 'p' then 1 when 'e' then 0 end as int) as class from train",
)
def q_label_targets(spark, sf):
    t = fx.train(spark, sf).select("id", F.expr(_UNMAPPED).alias("class"))
    return cleaning.label_targets(t)


@query(
    "unlabel_targets",
    fx.oracle_ctes("train")
    + f"""select id, case lab when 1 then 'p' when 0 then 'e' end as class from
          (select id, case {_UNMAPPED} when 'p' then 1 when 'e' then 0 end as lab from train) t""",
)
def q_unlabel_targets(spark, sf):
    t = cleaning.label_targets(fx.train(spark, sf).select("id", F.expr(_UNMAPPED).alias("class")))
    return cleaning.unlabel_targets(t)


def _clean_col_sql(col: str) -> str:
    return f"""k_{col} as (select value from (select {col} as value, count(*) as count from train where {col} is not null group by {col}) c
                where count >= cast(0.01 as double) * (select count({col}) from train))"""


@query(
    "engineer_features",
    fx.oracle_ctes("train")
    + ", "
    + _clean_col_sql("c_priority")
    + ", "
    + _clean_col_sql("c_status")
    + """ select id, x_price, x_month, coalesce(k_c_priority.value, 'dna') as c_priority,
                 coalesce(k_c_status.value, 'dna') as c_status,
                 cast(case class when 'p' then 1 when 'e' then 0 end as int) as class
          from train left join k_c_priority on train.c_priority = k_c_priority.value
                     left join k_c_status on train.c_status = k_c_status.value""",
)
def q_engineer_features(spark, sf):
    return cleaning.engineer_features(fx.train(spark, sf))


# ------------------------------------------------------------------ metrics
@query(
    "accuracy",
    fx.oracle_ctes("pred")
    + " union all ".join(
        f"select '{m}' as model, cast(sum(case when {m}=y then 1 else 0 end) as double)/count(*) as accuracy from pred"
        for m in fx.RULE_MODELS
    ),
)
def q_accuracy(spark, sf):
    return metrics.model_accuracy(fx.pred(spark, sf), fx.RULE_MODELS, "y")


@query(
    "cv_mean",
    fx.oracle_ctes("fold_scores") + "select combination, round(avg(score), 12) as score from fold_scores group by combination",
)
def q_cv_mean(spark, sf):
    m = metrics.mean_score_by_combination(fx.rule_fold_scores(spark, sf))
    return m.select("combination", r12(F.col("score")).alias("score"))


def _subset_oracle_body() -> str:
    """Brute-force subset vote in SQL: every pred row x every subset."""
    terms1 = " + ".join(
        f"case when (bitmap & {1 << j}) <> 0 and p{j + 1} = 1 then w{j + 1} else cast(0 as double) end" for j in range(4)
    )
    terms0 = " + ".join(
        f"case when (bitmap & {1 << j}) <> 0 and p{j + 1} = 0 then w{j + 1} else cast(0 as double) end" for j in range(4)
    )
    names = ", ".join(f"case when (bitmap & {1 << j}) <> 0 then 'p{j + 1}' end" for j in range(4))
    return (
        fx.oracle_ctes("results")
        + ", "
        + WEIGHTS_SQL
        + f""", subsets as (select range as bitmap from range(1, 16)),
        votes as (select pred.fold, pred.y, s.bitmap,
                         case when ({terms1}) > ({terms0}) then 1 else 0 end as v
                  from pred, subsets s, wp),
        ss as (select concat_ws('-', {names}) as combination, fold,
                      cast(sum(case when v = y then 1 else 0 end) as double) / count(*) as score
               from votes group by bitmap, fold)
        """
    )


@query("subset_scores", _subset_oracle_body() + "select combination, fold, round(score, 12) as score from ss")
def q_subset_scores(spark, sf):
    p = _pred_once(spark, sf)
    w = _models_weights(spark, sf, pred_df=p)
    s = vote.subset_scores(p, fx.RULE_MODELS, [w[m] for m in fx.RULE_MODELS], "y")
    return s.select("combination", "fold", r12(F.col("score")).alias("score"))


@query(
    "mean_score_by_combination",
    _subset_oracle_body() + "select combination, round(avg(score), 12) as score from ss group by combination",
)
def q_mean_score_by_combination(spark, sf):
    p = _pred_once(spark, sf)
    w = _models_weights(spark, sf, pred_df=p)
    s = vote.subset_scores(p, fx.RULE_MODELS, [w[m] for m in fx.RULE_MODELS], "y")
    return metrics.mean_score_by_combination(s).select("combination", r12(F.col("score")).alias("score"))


_BEST_SQL = """, ms as (select combination, round(avg(score), 12) as score from ss group by combination),
    best as (select combination, score from ms order by score desc, combination limit 1)
"""


@query(
    "best_combination",
    _subset_oracle_body()
    + _BEST_SQL
    + """select combination, score, cast(u.pos - 1 as int) as position, u.member from best,
         unnest(string_split(combination, '-')) with ordinality as u(member, pos)""",
)
def q_best_combination(spark, sf):
    p = _pred_once(spark, sf)
    w = _models_weights(spark, sf, pred_df=p)
    s = vote.subset_scores(p, fx.RULE_MODELS, [w[m] for m in fx.RULE_MODELS], "y")
    ms = metrics.mean_score_by_combination(s).select("combination", r12(F.col("score")).alias("score"))
    return metrics.best_combination(ms)


@query(
    "optimize_ensemble",
    _subset_oracle_body()
    + _BEST_SQL
    + "select ms.combination, ms.score, ms.combination = (select combination from best) as is_best from ms",
)
def q_optimize_ensemble(spark, sf):
    from tabula.plans.ensemble import optimize_ensemble_rules

    p = _pred_once(spark, sf)
    w = _models_weights(spark, sf, pred_df=p)
    return optimize_ensemble_rules(p, fx.RULE_MODELS, [w[m] for m in fx.RULE_MODELS], "y")


@query(
    "top_vs_singles",
    _subset_oracle_body()
    + _BEST_SQL
    + """select combination, score from ms
         where position('-' in combination) = 0
           and combination in (select unnest(string_split((select combination from best), '-')))
         union all select combination, score from best""",
)
def q_top_vs_singles(spark, sf):
    from tabula.plans.reports import top_vs_singles

    p = _pred_once(spark, sf)
    w = _models_weights(spark, sf, pred_df=p)
    s = vote.subset_scores(p, fx.RULE_MODELS, [w[m] for m in fx.RULE_MODELS], "y")
    ms = metrics.mean_score_by_combination(s).select("combination", r12(F.col("score")).alias("score"))
    return top_vs_singles(ms)


@query(
    "final_members",
    _subset_oracle_body()
    + _BEST_SQL
    + """select name, score, study from results
         where name like '%\\_top\\_0' escape '\\'
           and study in (select unnest(string_split((select combination from best), '-')))""",
)
def q_final_members(spark, sf):
    from tabula.plans.ensemble import final_members

    p = _pred_once(spark, sf)
    w = _models_weights(spark, sf, pred_df=p)
    s = vote.subset_scores(p, fx.RULE_MODELS, [w[m] for m in fx.RULE_MODELS], "y")
    ms = metrics.mean_score_by_combination(s).select("combination", r12(F.col("score")).alias("score"))
    best = metrics.best_combination(ms)
    res = fx.results(spark, sf, p).where(F.col("name").endswith("_top_0"))
    return final_members(res, best).select("name", "score", "study")


@query(
    "classification_metrics",
    fx.oracle_ctes("pred")
    + " union all ".join(
        f"""select '{m}' as model, fold,
              round(cast(sum(case when {m}=y then 1 else 0 end) as double)/count(*), 12) as accuracy,
              round(case when sum(case when {m}=1 then 1 else 0 end) = 0 then 0 else
                    cast(sum(case when {m}=1 and y=1 then 1 else 0 end) as double) / sum(case when {m}=1 then 1 else 0 end) end, 12) as precision,
              round(case when sum(case when y=1 then 1 else 0 end) = 0 then 0 else
                    cast(sum(case when {m}=1 and y=1 then 1 else 0 end) as double) / sum(case when y=1 then 1 else 0 end) end, 12) as recall,
              round(case when sum(case when {m}=1 then 1 else 0 end) + sum(case when y=1 then 1 else 0 end) = 0 then 0 else
                    cast(2*sum(case when {m}=1 and y=1 then 1 else 0 end) as double) /
                    (sum(case when {m}=1 then 1 else 0 end) + sum(case when y=1 then 1 else 0 end)) end, 12) as f1
            from pred group by fold"""
        for m in fx.RULE_MODELS
    ),
)
def q_classification_metrics(spark, sf):
    cm = metrics.classification_metrics(fx.pred(spark, sf), fx.RULE_MODELS, "y")
    return cm.select("model", "fold", *[r12(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(
    "fold_model_pivot",
    _subset_oracle_body()
    + """select fold, max(case when combination='p1' then score end) as p1, max(case when combination='p2' then score end) as p2,
                max(case when combination='p3' then score end) as p3, max(case when combination='p4' then score end) as p4,
                max(case when combination='p1-p2-p3-p4' then score end) as ensemble
         from ss group by fold""",
)
def q_fold_model_pivot(spark, sf):
    p = _pred_once(spark, sf)
    w = _models_weights(spark, sf, pred_df=p)
    p = p.withColumn("ensemble", vote.hard_vote_expr([F.col(m) for m in fx.RULE_MODELS], [w[m] for m in fx.RULE_MODELS]))
    scores = metrics.fold_scores(p, [*fx.RULE_MODELS, "ensemble"], "y")
    return metrics.fold_model_pivot(scores, [*fx.RULE_MODELS, "ensemble"])


# ------------------------------------------------------------------ votes
@query(
    "ensemble_weights",
    fx.oracle_ctes("results")
    + """select name, 'maximize' as direction, round(score / (select sum(score) from results), 12) as weight from results
         union all select name, 'minimize', round(1 - score / (select sum(score) from results), 12) from results
         union all select name, 'equal', round(1 / (select cast(count(*) as double) from results), 12) from results""",
)
def q_ensemble_weights(spark, sf):
    res = fx.results(spark, sf)
    out = None
    for d in ("maximize", "minimize", "equal"):
        part = vote.ensemble_weights(res, d).select("name", F.lit(d).alias("direction"), r12(F.col("weight")).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "vote_hard",
    fx.oracle_ctes("pred")
    + """select id, case when (case when p1=1 then 0.25 else 0 end + case when p2=1 then 0.25 else 0 end
                              + case when p3=1 then 0.25 else 0 end + case when p4=1 then 0.25 else 0 end) > 0.5
                         then 1 else 0 end as prediction from pred""",
)
def q_vote_hard(spark, sf):
    return vote.vote_hard(fx.pred(spark, sf), {m: 0.25 for m in fx.RULE_MODELS})


@query(
    "vote_string_labels",
    fx.oracle_ctes("results")
    + ", "
    + WEIGHTS_SQL
    + """select id, case when (case when p1=1 then w1 else cast(0 as double) end + case when p2=1 then w2 else cast(0 as double) end
                              + case when p3=1 then w3 else cast(0 as double) end + case when p4=1 then w4 else cast(0 as double) end)
                           > (case when p1=0 then w1 else cast(0 as double) end + case when p2=0 then w2 else cast(0 as double) end
                              + case when p3=0 then w3 else cast(0 as double) end + case when p4=0 then w4 else cast(0 as double) end)
                         then 'p' else 'e' end as prediction from pred, wp""",
)
def q_vote_string_labels(spark, sf):
    p0 = _pred_once(spark, sf)
    w = _models_weights(spark, sf, pred_df=p0)
    p = p0.select("id", *[F.when(F.col(m) == 1, "p").otherwise("e").alias(m) for m in fx.RULE_MODELS])
    return vote.vote_hard(p, w)


@query("align_predictions", fx.oracle_ctes("pred") + "select id, p1, p2, p3, p4 from pred")
def q_align_predictions(spark, sf):
    p = fx.pred(spark, sf)
    frames = {m: p.select("id", F.col(m).alias("prediction")) for m in fx.RULE_MODELS}
    return vote.align_predictions(frames)


@query(
    "ensemble_subsets",
    fx.oracle_ctes("results")
    + ", "
    + WEIGHTS_SQL
    + """, m as (select study as name, cast(row_number() over (order by study) - 1 as int) as position, weight from w),
         b as (select range as bitmap from range(1, 16)),
         bm as (select bitmap, name, position, weight from b join m on (bitmap & (1 << position)) <> 0),
         nm as (select bitmap, string_agg(name, '-' order by position) as combination from bm group by bitmap)
         select bm.bitmap, bm.position, bm.name, bm.weight, nm.combination from bm join nm using (bitmap)""",
)
def q_ensemble_subsets(spark, sf):
    res = fx.results(spark, sf).where(F.col("name").endswith("_top_0"))
    wt = vote.ensemble_weights(res).select(F.col("study").alias("name"), F.round("weight", 12).alias("weight"))
    from pyspark.sql import Window

    models = wt.withColumn("position", (F.row_number().over(Window.orderBy("name")) - 1).cast("int"))
    return vote.ensemble_subsets(models, len(fx.RULE_MODELS)).select("bitmap", "position", "name", "weight", "combination")


_SOFT_ORACLE = fx.oracle_ctes("proba") + """, mass as (
    select id, 0.5*(1-a) + 0.3*(1-b) + 0.2*(1-d) as m0, 0.5*a + 0.3*b + 0.2*d as m1 from proba)
"""


@query("vote_soft", _SOFT_ORACLE + "select id, case when m1 > m0 then 1 else 0 end as prediction from mass")
def q_vote_soft(spark, sf):
    p = fx.proba(spark, sf).select("id", *[vote.binary_proba_array(F.col(m)).alias(m) for m in fx.SOFT_MODELS])
    return vote.vote_soft(p, fx.SOFT_WEIGHTS)


@query("vote_probability", _SOFT_ORACLE + "select id, round(m1, 12) as probability from mass")
def q_vote_probability(spark, sf):
    p = fx.proba(spark, sf).select("id", *[vote.binary_proba_array(F.col(m)).alias(m) for m in fx.SOFT_MODELS])
    v = vote.vote_soft(p, fx.SOFT_WEIGHTS, target_class=1)
    return v.select("id", r12(F.col("probability")).alias("probability"))


@query(
    "argmax_label",
    fx.oracle_ctes("proba")
    + " union all ".join(
        f"select id, '{m}' as model, case when {m} > 1 - {m} then 1 else 0 end as label from proba" for m in fx.SOFT_MODELS
    ),
)
def q_argmax_label(spark, sf):
    p = fx.proba(spark, sf)
    long = metrics.unpivot_predictions(p, fx.SOFT_MODELS, keep=["id"], value_col="p1")
    return long.select("id", "model", vote.argmax_label(vote.binary_proba_array(F.col("p1"))).alias("label"))


@query(
    "test_ensemble",
    _subset_oracle_body()
    + """select combination, round(avg(score), 12) as score from ss
         where combination in ('p1', 'p2', 'p3', 'p4', 'p1-p2-p3-p4') group by combination""",
)
def q_test_ensemble(spark, sf):
    from tabula.plans.ensemble import test_ensemble_rules

    p = _pred_once(spark, sf)
    w = _models_weights(spark, sf, pred_df=p)
    return test_ensemble_rules(p, fx.RULE_MODELS, [w[m] for m in fx.RULE_MODELS], "y")


@query(
    "oof_predictions",
    fx.oracle_ctes("train")
    + f""", f as (select id, x_price, cast(ntile({K_FOLDS}) over (order by md5(concat('{folds.STACKING_FOLD_SEED}-', id)), id) - 1 as int) as fold from train),
        s as (select fold, sum(x_price) as sx, count(x_price) as nx from f group by fold),
        th as (select a.fold, (select sum(sx) from s) - a.sx as rest_sum, (select sum(nx) from s) - a.nx as rest_n from s a)
        select f.id, f.fold, round(rest_sum / rest_n, 6) as threshold,
               case when f.x_price > rest_sum / rest_n then 1 else 0 end as prediction
        from f join th using (fold)""",
)
def q_oof_predictions(spark, sf):
    from tabula.plans.ensemble import oof_mean_threshold

    f = folds.kfold_shuffled(fx.train(spark, sf).select("id", "x_price"), K_FOLDS, "id")
    out = oof_mean_threshold(f, "x_price")
    return out.select("id", "fold", F.round("threshold", 6).alias("threshold"), "prediction")


# ------------------------------------------------------------------ sources and sinks

TRAIN_SCHEMA = "id bigint, x_price double, x_month double, c_priority string, c_status string, class string"
_RES_COLS = "name, score, params, model, features, n_trials, metadata, study"


@query("scan_csv", fx.oracle_ctes("train") + "select * from train")
def q_scan_csv(spark, sf):
    path = csvio.write_csv(fx.train(spark, sf), scratch_path(spark, "train_csv"))
    return csvio.read_csv_table(spark, path, TRAIN_SCHEMA)


def _stored_results(spark, sf) -> str:
    root = scratch_path(spark, "results")
    res = fx.results(spark, sf)
    store.save_results(res.where(F.col("name").endswith("_top_0")), root, "run_a")
    store.save_results(res.where(~F.col("name").endswith("_top_0")), root, "run_b")
    return root


@query("list_results", fx.oracle_ctes("results") + "select distinct name from results")
def q_list_results(spark, sf):
    return store.list_results(spark, _stored_results(spark, sf))


@query("save_results", fx.oracle_ctes("results") + f"select {_RES_COLS} from results")
def q_save_results(spark, sf):
    root = scratch_path(spark, "results")
    store.save_results(fx.results(spark, sf), root, "run_a")
    return spark.read.parquet(root).select(*[c.strip() for c in _RES_COLS.split(",")])


@query(
    "read_run_results",
    fx.oracle_ctes("results") + f"select {_RES_COLS}, 'run_a' as run from results where name like '%\\_top\\_0' escape '\\'",
)
def q_read_run_results(spark, sf):
    return store.load_run_results(spark, _stored_results(spark, sf), "run_a").select(
        *[c.strip() for c in _RES_COLS.split(",")], "run"
    )


_SELECTION = ["p1_top_1", "p2_top_0", "p4_top_2"]


@query(
    "read_selected_results",
    fx.oracle_ctes("results") + f"select {_RES_COLS} from results where name in ('p1_top_1', 'p2_top_0', 'p4_top_2')",
)
def q_read_selected_results(spark, sf):
    res = store.read_selected_results(spark, _stored_results(spark, sf), _SELECTION)
    return res.select(*[c.strip() for c in _RES_COLS.split(",")])


@query("write_results_csv", fx.oracle_ctes("results") + "select name, score, params, model, features, n_trials, metadata from results")
def q_write_results_csv(spark, sf):
    path = csvio.write_csv(rep.results_report(fx.results(spark, sf)), scratch_path(spark, "results_csv"))
    return csvio.read_csv_table(
        spark, path, "name string, score double, params string, model string, features string, n_trials int, metadata string"
    )


@query(
    "write_scores_csv",
    _subset_oracle_body() + "select combination, round(avg(score), 12) as score from ss group by combination",
)
def q_write_scores_csv(spark, sf):
    path = csvio.write_csv(q_mean_score_by_combination(spark, sf), scratch_path(spark, "scores_csv"))
    return csvio.read_csv_table(spark, path, "combination string, score double")


@query(
    "write_predictions_csv",
    fx.oracle_ctes("pred")
    + """select id, case when (case when p1=1 then 0.25 else 0 end + case when p2=1 then 0.25 else 0 end
                              + case when p3=1 then 0.25 else 0 end + case when p4=1 then 0.25 else 0 end) > 0.5
                         then 'p' else 'e' end as class from pred""",
)
def q_write_predictions_csv(spark, sf):
    v = vote.vote_hard(fx.pred(spark, sf), {m: 0.25 for m in fx.RULE_MODELS}, out_col="class")
    path = csvio.write_csv(cleaning.unlabel_targets(v), scratch_path(spark, "pred_csv"))
    return csvio.read_csv_table(spark, path, "id bigint, class string")


@query("append_trials", fx.oracle_ctes("trials") + "select study, number, value, state from trials")
def q_append_trials(spark, sf):
    ev = spark.sql(fx.TRIALS_COLS_SQL, events=fx.table(spark, sf, "events"))
    half = ev.groupBy("study").agg(F.expr("percentile_disc(0.5) within group (order by event_id)").alias("__mid"))
    ev = ev.join(half, "study").withColumnRenamed("event_id", "seq")
    root = scratch_path(spark, "trials")
    store.append_trials(spark, root, ev.where(F.col("seq") <= F.col("__mid")).drop("__mid"))
    out = store.append_trials(spark, root, ev.where(F.col("seq") > F.col("__mid")).drop("__mid"))
    return out.select("study", "number", "value", "state")


@query(
    "study_trial_counts",
    fx.oracle_ctes("trials") + "select study, count(*) as n_trials from trials group by study",
)
def q_study_trial_counts(spark, sf):
    return store.study_trial_counts(fx.trials(spark, sf))


# ------------------------------------------------------------------ search state
def _recursive_trials_oracle(body: str) -> str:
    return (
        "with recursive "
        + fx.oracle_ctes("trials")[len("with ") :]
        + f""", r(study, number, best, cnt) as (
            select study, number, value, 0 from trials where number = 0
            union all
            select t.study, t.number,
                   case when r.best is null or (t.value is not null and t.value > r.best * cast({1 + MIN_IMPROVEMENT} as double))
                        then t.value else r.best end,
                   case when r.best is null or (t.value is not null and t.value > r.best * cast({1 + MIN_IMPROVEMENT} as double)) then 0
                        when t.value is not null then r.cnt + 1 else r.cnt end
            from r join trials t on t.study = r.study and t.number = r.number + 1)
        """
        + body
    )


@query(
    "patience_state",
    _recursive_trials_oracle(
        """select r.study, r.best as best_value, cast(r.cnt as bigint) as no_improvement_count
           from r join (select study, max(number) as mx from trials group by study) m
             on r.study = m.study and r.number = m.mx"""
    ),
)
def q_patience_state(spark, sf):
    return search.patience_state(fx.trials(spark, sf), MIN_IMPROVEMENT)


@query(
    "early_stop_point",
    _recursive_trials_oracle(
        f""", e(study, number, best, cnt) as (
            select study, number, value, 0 from trials where number = 0
            union all
            select t.study, t.number,
                   case when e.best is null or (t.value is not null and t.value > e.best * cast({1 + MIN_IMPROVEMENT} as double))
                        then t.value else e.best end,
                   case when e.best is null then 0
                        when t.value is not null and t.value > e.best * cast({1 + MIN_IMPROVEMENT} as double) then 0
                        else e.cnt + 1 end
            from e join trials t on t.study = e.study and t.number = e.number + 1)
        select s.study, cast(min(e.number) as bigint) as stop_number,
               arg_min(e.best, e.number) as best_value_at_stop, cast(s.n as bigint) as n_trials
        from (select study, count(*) as n from trials group by study) s
        left join e on e.study = s.study and e.cnt >= {PATIENCE}
        group by s.study, s.n"""
    ),
)
def q_early_stop_point(spark, sf):
    return search.early_stop_point(fx.trials(spark, sf), PATIENCE, MIN_IMPROVEMENT)


@query(
    "top_trials",
    fx.oracle_ctes("trials")
    + """select study, number, value, cast(rk as int) as rank, study || '_top_' || cast(rk as string) as name from (
           select *, row_number() over (partition by study order by value desc, number) - 1 as rk
           from trials where state = 'COMPLETE' and value is not null) t where rk < 3""",
)
def q_top_trials(spark, sf):
    return search.top_trials(fx.trials(spark, sf), k=3)


_SAMPLE_MODELS = tuple(search.DISPATCH_ORDER)


def _sample_trials_oracle() -> str:
    import math

    parts = []
    for m in _SAMPLE_MODELS:
        for j, (param, spec) in enumerate(search.SEARCH_SPACES[m].items()):
            g, slot = divmod(j, search.UNIFORMS_PER_HASH)
            h = f"md5(concat_ws('-', '42', study, cast(number as string), '{m}', '{g}'))"
            u = f"(('0x' || substr({h}, {1 + 8 * slot}, 8))::bigint / cast(4294967296 as double))"
            kind = spec[0]
            if kind == "log":
                val = f"exp({math.log(spec[1])!r} + {u} * {math.log(spec[2] / spec[1])!r})"
                ch = "cast(null as string)"
            elif kind == "float":
                val = f"(cast({float(spec[1])!r} as double) + {u} * cast({float(spec[2] - spec[1])!r} as double))"
                ch = "cast(null as string)"
            elif kind == "int":
                step = spec[3] if len(spec) > 3 else 1
                n = (spec[2] - spec[1]) // step + 1
                val = f"cast({spec[1]} + {step} * floor({u} * {n}) as double)"
                ch = "cast(null as string)"
            else:
                choices = ", ".join("'" + (c if c is not None else "None") + "'" for c in spec[1])
                val = "cast(null as double)"
                ch = f"([{choices}])[cast(floor({u} * {len(spec[1])}) as bigint) + 1]"
            parts.append(
                f"select study, number, '{m}' as model, '{param}' as param, round({val}, 9) as value, {ch} as choice from trials"
            )
    return fx.oracle_ctes("trials") + " union all ".join(parts)


@query("sample_trials", _sample_trials_oracle())
def q_sample_trials(spark, sf):
    s = search.sample_trials(fx.trials(spark, sf).select("study", "number"), _SAMPLE_MODELS, seed=42)
    return s.select("study", "number", "model", "param", F.round("value", 9).alias("value"), "choice")


# ------------------------------------------------------------------ reports and candidates


@query("results_report", fx.oracle_ctes("results") + "select name, score, params, model, features, n_trials, metadata from results")
def q_results_report(spark, sf):
    return rep.results_report(fx.results(spark, sf))


@query(
    "params_match",
    fx.oracle_ctes("results")
    + """, fs2 as (select combination, fold from fold_scores)
         select r.name, 'fold' as key, cast(json_extract_string(replace(r.params, '''', '"'), '$.fold') as string) as stored,
                cast(f.fold as string) as actual,
                cast(json_extract_string(replace(r.params, '''', '"'), '$.fold') as string) = cast(f.fold as string) as match
         from results r left join (select combination || '_top_' || cast(row_number() over (partition by combination order by score desc, fold) - 1 as string) as name, fold
                                   from fold_scores) f on r.name = f.name""",
)
def q_params_match(spark, sf):
    res = fx.results(spark, sf)
    tr = fx.rule_fold_scores(spark, sf).select(
        F.col("combination").alias("study"), F.col("fold").cast("long").alias("number"), F.col("score").alias("value"), F.lit("COMPLETE").alias("state")
    )
    actual = search.top_trials(tr, k=3).select("name", F.lit("fold").alias("key"), F.col("number").cast("string").alias("value"))
    return rep.params_match(res, actual)


@query(
    "pending_candidates",
    fx.oracle_ctes("results")
    + """, c as (select study || '_' as name from results union select 'p5_' union select 'p9_'),
         stored as (select name from results where round(score, 9) >= (select round(avg(score), 9) from results))
         select distinct name from c where not exists (
           select 1 from stored r where r.name in (c.name || 'top_0', c.name || 'top_1', c.name || 'top_2'))""",
)
def q_pending_candidates(spark, sf):
    res = fx.results(spark, sf)
    extra = spark.createDataFrame([("p5_",), ("p9_",)], "name string")
    cands = res.select(F.concat(F.col("study"), F.lit("_")).alias("name")).unionByName(extra).distinct()
    # stored so far: the results of at least average score. A candidate with one of
    # its top results stored is finished
    mean = res.select(F.round(F.avg("score"), 9)).first()[0]
    return cand.pending_candidates(cands, res.where(F.round("score", 9) >= mean))


@query(
    "feature_set_ablation",
    fx.oracle_ctes("train")
    + """, base as (select c_priority, c_status, x_month, class, count(*) as n from train group by c_priority, c_status, x_month, class),
         cb as (select c_priority, c_status, x_month, class, sum(n) as n,
                       grouping_id(c_priority, c_status, x_month, class) as gid
                from base group by cube(c_priority, c_status, x_month, class)),
         k as (select *, row_number() over (partition by gid, c_priority, c_status, x_month order by n desc, class) as r
               from cb where gid % 2 = 0)
         select cast((case when gid & 8 = 0 then 1 else 0 end) + (case when gid & 4 = 0 then 2 else 0 end)
                     + (case when gid & 2 = 0 then 4 else 0 end) as int) as mask,
                concat_ws('_', case when gid & 8 = 0 then 'c_priority' end, case when gid & 4 = 0 then 'c_status' end,
                          case when gid & 2 = 0 then 'x_month' end) as features,
                count(*) as n_keys, sum(n) / (select cast(count(*) as double) from train) as accuracy
         from k where r = 1 group by gid""",
)
def q_feature_set_ablation(spark, sf):
    return cand.ablation_accuracy(fx.train(spark, sf), ["c_priority", "c_status", "x_month"], "class")


# ------------------------------------------------------------------ preprocessing


_PP_FEATURES = ["x_price", "x_month", "c_priority", "c_status"]
_UNSEEN = "case when x_month = 12 then 'Z' else c_status end"


def _fit_apply(spark, sf):
    """Train rows with contiguous folds: fit on folds 1-4, apply to fold 0
    (fold 0 gets one unseen status value)."""
    t = folds.kfold_contiguous(fx.train(spark, sf).drop("class"), K_FOLDS, ["id"])
    fit_rows = t.where(F.col("fold") != 0).drop("fold")
    apply_rows = t.where(F.col("fold") == 0).drop("fold").withColumn("c_status", F.expr(_UNSEEN))
    return fit_rows, apply_rows


_FA_SQL = (
    fx.oracle_ctes("train")
    + f""", tf as (select *, cast(ntile({K_FOLDS}) over (order by id) - 1 as int) as fold from train),
    fr as (select id, x_price, x_month, coalesce(c_priority, 'dna') as c_priority, c_status from tf where fold <> 0),
    ar as (select id, x_price, x_month, coalesce(c_priority, 'dna') as c_priority, {_UNSEEN} as c_status from tf where fold = 0),
    vocab as (select 'c_priority' as col, value, cast(row_number() over (order by value) - 1 as int) as idx
              from (select distinct c_priority as value from fr) a
              union all
              select 'c_status' as col, value, cast(row_number() over (order by value) - 1 as int) as idx
              from (select distinct c_status as value from fr) b),
    pm as (select avg(x_price) as mp from fr),
    fi as (select coalesce(x_price, (select mp from pm)) as xp, x_month from fr),
    st as (select avg(xp) as m1, stddev_pop(xp) as s1, avg(x_month) as m2, stddev_pop(x_month) as s2 from fi),
    kp as (select count(*) - 1 as k from vocab where col = 'c_priority'),
    slots as (
      select ar.id, 0 as slot, 'x_price' as feature, (coalesce(ar.x_price, (select mp from pm)) - st.m1) / case when st.s1 = 0 then 1 else st.s1 end as value from ar, st
      union all
      select ar.id, 1, 'x_month', (ar.x_month - st.m2) / case when st.s2 = 0 then 1 else st.s2 end from ar, st
      union all
      select ar.id, 2 + v.idx - 1, 'c_priority_' || v.value, case when ar.c_priority = v.value then 1.0 else 0.0 end
      from ar, vocab v where v.col = 'c_priority' and v.idx >= 1
      union all
      select ar.id, 2 + (select k from kp) + v.idx - 1, 'c_status_' || v.value, case when ar.c_status = v.value then 1.0 else 0.0 end
      from ar, vocab v where v.col = 'c_status' and v.idx >= 1)
    """
)


def _fitted_pipeline(spark, sf):
    fit_rows, apply_rows = _fit_apply(spark, sf)
    pipe = pp.build_preprocessing(fit_rows.schema, features_in=_PP_FEATURES)
    model = pipe.fit(fit_rows)
    names = pp.feature_names(model, fit_rows.schema, _PP_FEATURES)
    return model.transform(apply_rows), names


@query("assemble_features", _FA_SQL + "select id, cast(slot as int) as slot, round(value, 9) as value from slots")
def q_assemble_features(spark, sf):
    out, names = _fitted_pipeline(spark, sf)
    return pp.features_long(out, names, "id").select("id", "slot", F.round("value", 9).alias("value"))


@query("pipeline_transform", _FA_SQL + "select id, feature, round(value, 9) as value from slots")
def q_pipeline_transform(spark, sf):
    out, names = _fitted_pipeline(spark, sf)
    wide = pp.dense_named(out, names, keep=["id"])
    long = metrics.unpivot_predictions(wide, names, keep=["id"], model_col="feature", value_col="value")
    return long.select("id", "feature", F.round("value", 9).alias("value"))


@query(
    "one_hot_drop_first",
    _FA_SQL
    + """select ar.id, v.col as "column", v.value as category from ar join vocab v
           on (v.col = 'c_priority' and ar.c_priority = v.value) or (v.col = 'c_status' and ar.c_status = v.value)
         where v.idx >= 1""",
)
def q_one_hot_drop_first(spark, sf):
    fit_rows, apply_rows = _fit_apply(spark, sf)
    cols = ["c_priority", "c_status"]
    fill = pp.build_preprocessing(fit_rows.schema, features_in=cols).getStages()[0]
    fit_s, apply_s = fill.transform(fit_rows), fill.transform(apply_rows)
    model = pp.DropFirstOneHot(inputCols=[f"{c}__str" for c in cols]).fit(fit_s)
    labels = pp.one_hot_labels(model)
    out = model.transform(apply_s)
    parts = []
    for c in cols:
        lab = F.array(*[F.lit(v) for v in labels[f"{c}__str"]])
        hot = out.select("id", F.posexplode(vector_to_array(F.col(f"{c}__str_ohe"))).alias("slot", "v")).where("v = 1.0")
        parts.append(hot.select("id", F.lit(c).alias("column"), F.element_at(lab, F.col("slot") + 1).alias("category")))
    return parts[0].unionByName(parts[1])


@query(
    "category_vocab",
    _FA_SQL + 'select col as "column", idx, value from vocab',
)
def q_category_vocab(spark, sf):
    fit_rows, _ = _fit_apply(spark, sf)
    cols = ["c_priority", "c_status"]
    return vocabulary.vocabulary(fit_rows, cols)


@query(
    "pipeline_passthrough",
    _FA_SQL
    + """select ar.id, round((coalesce(ar.x_price, (select mp from pm)) - st.m1) / case when st.s1 = 0 then 1 else st.s1 end, 9) as x_price,
                round((ar.x_month - st.m2) / case when st.s2 = 0 then 1 else st.s2 end, 9) as x_month,
                ar.c_priority, ar.c_status from ar, st""",
)
def q_pipeline_passthrough(spark, sf):
    fit_rows, apply_rows = _fit_apply(spark, sf)
    pipe = pp.build_preprocessing(fit_rows.schema, features_in=_PP_FEATURES, allow_strings=True, keep=["id"])
    out = pipe.fit(fit_rows).transform(apply_rows)
    return out.select("id", F.round("x_price", 9).alias("x_price"), F.round("x_month", 9).alias("x_month"), "c_priority", "c_status")


@query("impute_constant", fx.oracle_ctes("train") + "select id, coalesce(c_priority, 'dna') as c_priority from train")
def q_impute_constant(spark, sf):
    t = fx.train(spark, sf).select("id", "c_priority")
    fill = pp.build_preprocessing(t.schema, features_in=["c_priority"], allow_strings=True, keep=["id"])
    return fill.fit(t).transform(t)


@query(
    "impute_mean",
    """with dl as (select d.doc_id, cast(l.quality as double) as quality, cast(l.toxic as double) as toxic
                   from documents d left join labels l on d.doc_id = l.doc_id)
       select doc_id, round(coalesce(quality, (select avg(quality) from dl)), 12) as quality,
              round(coalesce(toxic, (select avg(toxic) from dl)), 12) as toxic from dl""",
)
def q_impute_mean(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id")
    lab = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double"), F.col("toxic").cast("double"))
    dl = d.join(lab, "doc_id", "left")
    imp = Imputer(strategy="mean", inputCols=["quality", "toxic"], outputCols=["quality", "toxic"]).fit(dl)
    out = imp.transform(dl)
    return out.select("doc_id", r12(F.col("quality")).alias("quality"), r12(F.col("toxic")).alias("toxic"))


@query(
    "standard_scale",
    fx.oracle_ctes("train")
    + """, ti as (select id, coalesce(x_price, (select avg(x_price) from train)) as xp, x_month, cast(1 as double) as const from train),
         st as (select avg(xp) m1, stddev_pop(xp) s1, avg(x_month) m2, stddev_pop(x_month) s2, avg(const) m3, stddev_pop(const) s3 from ti)
         select id, round((xp - m1) / case when s1 = 0 then 1 else s1 end, 9) as x_price,
                round((x_month - m2) / case when s2 = 0 then 1 else s2 end, 9) as x_month,
                round((const - m3) / case when s3 = 0 then 1 else s3 end, 9) as const from ti, st""",
)
def q_standard_scale(spark, sf):
    t = fx.train(spark, sf).select("id", "x_price", "x_month", F.lit(1.0).alias("const"))
    cols = ["x_price", "x_month", "const"]
    t = Imputer(strategy="mean", inputCols=cols, outputCols=cols).fit(t).transform(t)
    sc = pp.PopulationScaler(inputCols=cols, outputCols=cols).fit(t)
    return sc.transform(t).select("id", *[F.round(c, 9).alias(c) for c in cols])


# ------------------------------------------------------------------ learners


RIDGE_ALPHA = 10.0
KNN_K = 5


@query(
    "ridge_classify",
    fx.oracle_ctes("train")
    + f""", ti as (select id, coalesce(x_price, (select avg(x_price) from train)) as xp,
                         case when class = 'p' then cast(1 as double) else cast(-1 as double) end as ys from train),
         st as (select avg(xp) as m, stddev_pop(xp) as s from ti),
         xs as (select id, (xp - m) / s as x, ys from ti, st),
         co as (select count(*) as n, covar_pop(x, ys) as c, var_pop(x) as v, avg(x) as mx, avg(ys) as my from xs),
         wb as (select n * c / (n * v + {RIDGE_ALPHA}) as w, my - (n * c / (n * v + {RIDGE_ALPHA})) * mx as b from co)
         select id, case when w * x + b > 0 then 1 else 0 end as prediction from xs, wb""",
)
def q_ridge_classify(spark, sf):
    t = cleaning.label_targets(fx.train(spark, sf).select("id", "x_price", "class"))
    t = Imputer(strategy="mean", inputCols=["x_price"], outputCols=["x_price"]).fit(t).transform(t)
    t = pp.PopulationScaler(inputCols=["x_price"], outputCols=["x_price"]).fit(t).transform(t)
    t = VectorAssembler(inputCols=["x_price"], outputCol="features").transform(t)
    model = lrn.RidgeClassifier(alpha=RIDGE_ALPHA, labelCol="class").fit(t)
    return model.transform(t).select("id", F.col("prediction").cast("int").alias("prediction"))


@query(
    "samme_round",
    fx.oracle_ctes("pred")
    + """, m as (select id, case when p1 <> y then cast(1 as double) else cast(0 as double) end as miss,
                        cast(1 as double) / count(*) over () as w from pred),
         e as (select sum(w * miss) / sum(w) as err from m),
         a as (select err, ln((1 - err) / err) as alpha from e),
         nw as (select id, w * exp(alpha * miss) as w2, err, alpha from m, a)
         select id, round(w2 / (select sum(w2) from nw), 12) as weight, round(err, 12) as err, round(alpha, 12) as alpha from nw""",
)
def q_samme_round(spark, sf):
    p = fx.pred(spark, sf)
    n = p.select(F.count(F.lit(1))).scalar()
    m = p.select("id", (F.col("p1") != F.col("y")).cast("double").alias("miss"), (F.lit(1.0) / n).alias("w"))
    out = boosting.samme_reweight(m, "miss", "w", learning_rate=1.0)
    return out.select("id", r12(F.col("w")).alias("weight"), r12(F.col("err")).alias("err"), r12(F.col("alpha")).alias("alpha"))


@query(
    "knn_cosine",
    f"""with q as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id % 5 = 0),
        r as (select vec_id, cast(embedding as double[]) as e, label from embeddings where vec_id % 5 <> 0),
        s as (select q.vec_id as qid, r.vec_id as rid, r.label, list_cosine_similarity(q.e, r.e) as sim from q, r),
        t as (select *, row_number() over (partition by qid order by sim desc, rid) as rk from s),
        v as (select qid, label, count(*) as c from t where rk <= {KNN_K} group by qid, label),
        w as (select qid, label, row_number() over (partition by qid order by c desc, label) as r2 from v)
        select qid, label as prediction from w where r2 = 1""",
)
def q_knn_cosine(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    is_query = (F.col("vec_id") % 5) == 0
    q = e.where(is_query).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    r = e.where(~is_query).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return lrn.knn_vote(lrn.knn_cosine(q, r, KNN_K))


def _learner_fold0(spark, sf, model_name: str, params: dict) -> DataFrame:
    """Preprocessing + learner fitted on folds 1-4 of ``train``, scored on fold 0."""
    t = cleaning.label_targets(fx.train(spark, sf)).withColumn("class", F.col("class").cast("double"))
    t = folds.kfold_contiguous(t, K_FOLDS, ["id"])
    fit_rows, apply_rows = t.where(F.col("fold") != 0), t.where(F.col("fold") == 0)
    est = lrn.make_learner(model_name, params, label_col="class")
    pipe = pp.build_preprocessing(fit_rows.schema, features_in=_PP_FEATURES, model=est, model_name=model_name)
    out = pipe.fit(fit_rows).transform(apply_rows)
    return out.select("id", F.col("prediction").cast("int").alias("prediction"), F.col("class").cast("int").alias("label"))


@query("gbt_classify")
def q_gbt_classify(spark, sf):
    return _learner_fold0(spark, sf, "XGBClassifier", {"n_estimators": 20, "max_depth": 4, "learning_rate": 0.2})


@query("catboost_early_stop")
def q_catboost_early_stop(spark, sf):
    return _learner_fold0(spark, sf, "CatBoostClassifier", {"iterations": 25, "depth": 4, "learning_rate": 0.3, "od_wait": 4, "scale_pos_weight": 1.5})


@query("random_forest")
def q_random_forest(spark, sf):
    return _learner_fold0(spark, sf, "RandomForestClassifier", {"n_estimators": 30, "max_depth": 6, "max_features": "sqrt"})


@query("linear_svc")
def q_linear_svc(spark, sf):
    return _learner_fold0(spark, sf, "SVC", {"C": 1.0, "kernel": "linear"})


@query("adaboost_samme")
def q_adaboost_samme(spark, sf):
    return _learner_fold0(spark, sf, "AdaBoostClassifier", {"n_estimators": 5, "learning_rate": 0.5})


@query("score_models")
def q_score_models(spark, sf):
    from tabula.plans.ensemble import score_members

    t = cleaning.label_targets(fx.train(spark, sf)).withColumn("class", F.col("class").cast("double"))
    members = {
        "RidgeClassifier_top_0": ("RidgeClassifier", {"alpha": 1.0}),
        "LGBMClassifier_top_0": ("LGBMClassifier", {"n_estimators": 15, "max_depth": 4, "learning_rate": 0.3}),
    }
    return score_members(t, t, members, _PP_FEATURES, "class", method="predict")


# ------------------------------------------------------------------ jobs (rows-only checks)

_JOB_FEATURES = _PP_FEATURES


def _labelled_train(spark, sf):
    return cleaning.engineer_features(fx.train(spark, sf)).withColumn("class", F.col("class").cast("double"))


_STACK_MEMBERS = {
    "RidgeClassifier_top_0": ("RidgeClassifier", {"alpha": 1.0}),
    "RandomForestClassifier_top_0": ("RandomForestClassifier", {"n_estimators": 10, "max_depth": 5}),
}


@query("cv_objective")
def q_cv_objective(spark, sf):
    t = _labelled_train(spark, sf)
    trials = [{"alpha": 0.1}, {"alpha": 10.0}, {"alpha": 1000.0}]
    scores = jobs.cv_objective(t, "RidgeClassifier", trials, _JOB_FEATURES, "class", n_cv=K_FOLDS)
    return spark.createDataFrame([(json.dumps(p), s) for p, s in zip(trials, scores)], "params string, score double")


@query("search_study")
def q_search_study(spark, sf):
    t = _labelled_train(spark, sf)
    root = scratch_path(spark, "trials")
    return jobs.search_study(spark, t, "RidgeClassifier_", "RidgeClassifier", _JOB_FEATURES, "class", root, n_trials=6, batch=3)


@query("search_job")
def q_search_job(spark, sf):
    return jobs.search_job(
        spark, fx.train(spark, sf), ["RidgeClassifier", "SVC"], _JOB_FEATURES,
        scratch_path(spark, "results"), scratch_path(spark, "trials"), limit_data_percentage=0.15, n_trials=3, batch=3, n_cv=3,
    )


@query("stacking_fit")
def q_stacking_fit(spark, sf):
    t = folds.kfold_contiguous(_labelled_train(spark, sf), K_FOLDS, ["id"])
    oof = stacking.Stacking(_STACK_MEMBERS, _JOB_FEATURES, "class", k=3).out_of_fold(t.where("fold <> 0").drop("fold"))
    return oof.select("id", *[F.col(f"m_{n}").cast("int").alias(n) for n in _STACK_MEMBERS])


@query("stacking_predict")
def q_stacking_predict(spark, sf):
    t = folds.kfold_contiguous(_labelled_train(spark, sf), K_FOLDS, ["id"])
    st = stacking.Stacking(_STACK_MEMBERS, _JOB_FEATURES, "class", k=3).fit(t.where("fold <> 0").drop("fold"))
    out = st.transform(t.where("fold = 0").drop("fold"))
    return out.select("id", F.col("prediction").cast("int").alias("prediction"), F.col("class").cast("int").alias("label"))


@query("compare_ensembles")
def q_compare_ensembles(spark, sf):
    members = {
        "LGBMClassifier_top_0": ("LGBMClassifier", {"n_estimators": 5, "max_depth": 4, "learning_rate": 0.3}),
        "RandomForestClassifier_top_0": ("RandomForestClassifier", {"n_estimators": 5, "max_depth": 5}),
    }
    return ens.compare_ensembles(_labelled_train(spark, sf), members, _JOB_FEATURES, "class", k=2, inner_k=2)


# Member configurations of the ensemble jobs (model family + parameters), the
# counterpart of the ensemble config file; scores always come from the data.
_ENSEMBLE_MEMBERS = {
    "RidgeClassifier_top_0": ("RidgeClassifier", {"alpha": 1.0}),
    "RandomForestClassifier_top_0": ("RandomForestClassifier", {"n_estimators": 10, "max_depth": 5}),
    "LGBMClassifier_top_0": ("LGBMClassifier", {"n_estimators": 10, "max_depth": 4, "learning_rate": 0.3}),
}


def _member_results(spark, sf) -> DataFrame:
    """Search-result rows for the ensemble members: each score is the member's
    3-fold stratified CV accuracy on the cleaned ``train`` table."""
    scores = jobs.members_cv_accuracy(checkpointed(_labelled_train(spark, sf)), _ENSEMBLE_MEMBERS, _JOB_FEATURES, "class", n_cv=3)
    rows = [(name, float(scores[name]), json.dumps(params), model) for name, (model, params) in _ENSEMBLE_MEMBERS.items()]
    return spark.createDataFrame(rows, "name string, score double, params string, model string")


@query("ensemble_job")
def q_ensemble_job(spark, sf):
    out = scratch_path(spark, "ensemble_job")
    return jobs.ensemble_job(spark, fx.train(spark, sf), _member_results(spark, sf), list(_ENSEMBLE_MEMBERS),
                             _JOB_FEATURES, out, sample_fraction=0.5, n_cv=3)


@query("predict_job")
def q_predict_job(spark, sf):
    t = folds.kfold_contiguous(fx.train(spark, sf), K_FOLDS, ["id"])
    train, test = t.where("fold <> 0").drop("fold"), t.where("fold = 0").drop("fold", "class")
    d = scratch_path(spark, "ensemble")
    members = dict(_ENSEMBLE_MEMBERS)
    jobs.save_ensemble(spark, d, members, {n: 1.0 / len(members) for n in members}, _JOB_FEATURES, train.schema)
    return jobs.predict_job(spark, train, test, d, scratch_path(spark, "predictions_csv"))


@query("ensemble_save_load")
def q_ensemble_save_load(spark, sf):
    t = folds.kfold_contiguous(_labelled_train(spark, sf), K_FOLDS, ["id"])
    d = scratch_path(spark, "ensemble")
    members = dict(_ENSEMBLE_MEMBERS)
    jobs.save_ensemble(spark, d, members, {n: 1.0 / len(members) for n in members}, _JOB_FEATURES, t.schema)
    _, weights, _, pipes = jobs.load_ensemble(spark, d)
    fitted = ens.fit_pipelines(pipes, t.where("fold <> 0"), "class")
    return ens.hard_vote_predict(fitted, t.where("fold = 0"), weights)


@query(
    "prediction_parity",
    fx.oracle_ctes("pred")
    + " union all ".join(f"select '{m}' as model, count(*) as n, cast(0 as bigint) as mismatches from pred" for m in fx.RULE_MODELS),
)
def q_prediction_parity(spark, sf):
    """The rule models' columns, aligned by id and as they stand."""
    p = fx.pred(spark, sf)
    inside = vote.align_predictions({m: p.select("id", F.col(m).alias("prediction")) for m in fx.RULE_MODELS})
    return rep.prediction_parity(inside, p.select("id", *fx.RULE_MODELS), fx.RULE_MODELS)


@query(
    "prediction_parity_fitted",
    fx.oracle_ctes("train")
    + " union all ".join(f"select '{m}' as model, count(*) as n, cast(0 as bigint) as mismatches from train where class is not null" for m in _ENSEMBLE_MEMBERS),
)
def q_prediction_parity_fitted(spark, sf):
    """R4 with fitted members: inside a saved and loaded ensemble against the stand-alone models."""
    return jobs.fitted_parity(_labelled_train(spark, sf), _ENSEMBLE_MEMBERS, _JOB_FEATURES, scratch_path(spark, "parity"))
