"""Fixture views over the driver tables.

Each view is derived from the given tables, so its work grows with them. The
SQL texts use ``{table}`` placeholders: Spark binds DataFrames through
``spark.sql(text, **frames)``; the DuckDB oracle substitutes view names.
Where a SQL form would need a single-partition window (``ntile`` / global
``row_number``), the Spark side uses the distributed operators instead and
only the oracle keeps the window form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.operators.folds import kfold_contiguous
from tabula.operators.metrics import fold_scores
from tabula.operators.rowindex import with_group_row_number

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

RULE_MODELS = ("p1", "p2", "p3", "p4")
SOFT_MODELS = ("a", "b", "d")
# Soft-vote weights of the three score models of ``proba``.
SOFT_WEIGHTS = {"a": 0.5, "b": 0.3, "d": 0.2}
RULE_FEATURES = {
    "p1": "['x_price']",
    "p2": "['c_priority']",
    "p3": "['x_price', 'c_status']",
    "p4": "['x_month']",
}

TRAIN_SQL = """
select id, x_price, x_month, c_priority, c_status,
       case when x_price/500000.0 + case when c_priority='1-URGENT' then 0.25 else 0.0 end
                 - case when c_status='P' then 0.15 else 0.0 end
                 + 0.3*(noise/1000.0-0.5) > 0.5 then 'p' else 'e' end as class
from (select o_orderkey as id,
             case when o_orderkey%50=0 then null else o_totalprice end as x_price,
             cast(month(o_orderdate) as double) as x_month,
             nullif(o_orderpriority,'4-NOT SPECIFIED') as c_priority,
             o_orderstatus as c_status,
             (o_custkey*7919+o_orderkey*104729)%1000 as noise
      from {orders}) t
"""

PRED_COLS_SQL = """
select id, case when class='p' then 1 else 0 end as y,
       case when x_price>250000 then 1 else 0 end as p1,
       case when c_priority in ('1-URGENT','2-HIGH') then 1 else 0 end as p2,
       case when x_price>150000 and c_status<>'P' then 1 else 0 end as p3,
       case when x_month<=6 then 1 else 0 end as p4
from {train}
"""

PRED_SQL_ORACLE = """
select id, case when class='p' then 1 else 0 end as y,
       case when x_price>250000 then 1 else 0 end as p1,
       case when c_priority in ('1-URGENT','2-HIGH') then 1 else 0 end as p2,
       case when x_price>150000 and c_status<>'P' then 1 else 0 end as p3,
       case when x_month<=6 then 1 else 0 end as p4,
       cast(ntile(5) over (order by id)-1 as int) as fold
from {train}
"""

PROBA_SQL = """
select o_orderkey as id,
       least(cast(1 as double), o_totalprice/cast(500000 as double)) as a,
       month(o_orderdate)/cast(12 as double) as b,
       case when o_orderstatus='F' then cast(0.9 as double) else cast(0.2 as double) end as d
from {orders}
"""

TRIALS_COLS_SQL = """
select event_type as study, event_id,
       case when event_id%37=0 then null else value end as value,
       case when event_id%37=0 then 'FAIL' else 'COMPLETE' end as state
from {events}
"""

TRIALS_SQL_ORACLE = """
select event_type as study,
       cast(row_number() over (partition by event_type order by event_id)-1 as bigint) as number,
       case when event_id%37=0 then null else value end as value,
       case when event_id%37=0 then 'FAIL' else 'COMPLETE' end as state
from {events}
"""

FOLD_SCORES_SQL_ORACLE = " union all ".join(
    f"select '{m}' as combination, fold, cast(sum(case when {m}=y then 1 else 0 end) as double)/count(*) as score "
    "from {pred} group by fold"
    for m in RULE_MODELS
)

RESULTS_SQL_ORACLE = """
select name, score, params, model, features, n_trials, metadata, study
from (select combination || '_top_' || cast(rk - 1 as string) as name, score,
             '{''fold'': ' || cast(fold as string) || '}' as params,
             'RuleModel(' || combination || ')' as model,
             case combination when 'p1' then '[''x_price'']' when 'p2' then '[''c_priority'']'
                  when 'p3' then '[''x_price'', ''c_status'']' else '[''x_month'']' end as features,
             cast(n_trials as int) as n_trials,
             '{''limit_data_percentage'': 1.0}' as metadata,
             combination as study
      from (select combination, fold, score,
                   row_number() over (partition by combination order by score desc, fold) as rk,
                   count(*) over (partition by combination) as n_trials
            from {fold_scores}) r
      where rk <= 3) t
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRAIN_SQL, orders=table(spark, sf_dir, "orders"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.sql(PRED_COLS_SQL, train=train(spark, sf_dir))
    return kfold_contiguous(base, 5, ["id"])


def proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROBA_SQL, orders=table(spark, sf_dir, "orders"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.sql(TRIALS_COLS_SQL, events=table(spark, sf_dir, "events"))
    numbered = with_group_row_number(base, ["study"], ["event_id"], "number")
    return numbered.select("study", (F.col("number") - 1).cast("long").alias("number"), "value", "state")


def rule_fold_scores(spark: SparkSession, sf_dir: str, pred_df: DataFrame | None = None) -> DataFrame:
    return fold_scores(pred_df if pred_df is not None else pred(spark, sf_dir), RULE_MODELS, "y")


def results(spark: SparkSession, sf_dir: str, pred_df: DataFrame | None = None) -> DataFrame:
    """Search-result rows derived from the rule models' fold scores: each model
    is a study, each fold a trial, the best three become ``<model>_top_<k>``."""
    from tabula.plans.search import top_trials

    fs = rule_fold_scores(spark, sf_dir, pred_df)
    tr = fs.select(F.col("combination").alias("study"), F.col("fold").cast("long").alias("number"), F.col("score").alias("value"), F.lit("COMPLETE").alias("state"))
    top = top_trials(tr, k=3)
    n_trials = tr.groupBy("study").agg(F.count(F.lit(1)).cast("int").alias("n_trials"))
    feats = F.create_map(*[x for m in RULE_MODELS for x in (F.lit(m), F.lit(RULE_FEATURES[m]))])
    return top.join(n_trials, "study").select(
        "name",
        F.col("value").alias("score"),
        F.concat(F.lit("{'fold': "), F.col("number").cast("string"), F.lit("}")).alias("params"),
        F.concat(F.lit("RuleModel("), F.col("study"), F.lit(")")).alias("model"),
        F.element_at(feats, F.col("study")).alias("features"),
        "n_trials",
        F.lit("{'limit_data_percentage': 1.0}").alias("metadata"),
        "study",
    )


def _bind(text: str, *names: str) -> str:
    for n in names:
        text = text.replace("{" + n + "}", n)
    return text


def oracle_ctes(*names: str) -> str:
    """``with`` clause defining the fixture views for DuckDB."""
    defs = {
        "train": _bind(TRAIN_SQL, "orders"),
        "pred": _bind(PRED_SQL_ORACLE, "train"),
        "proba": _bind(PROBA_SQL, "orders"),
        "trials": _bind(TRIALS_SQL_ORACLE, "events"),
        "fold_scores": _bind(FOLD_SCORES_SQL_ORACLE, "pred"),
        "results": _bind(RESULTS_SQL_ORACLE, "fold_scores"),
    }
    deps = {"pred": ["train"], "fold_scores": ["pred"], "results": ["fold_scores"]}
    order: list[str] = []

    def add(n):
        for d in deps.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({defs[n]})" for n in order) + "\n"
