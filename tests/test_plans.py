"""Plan-shape checks: the scale properties the operators rely on must show up
in the physical plans (partial aggregation, broadcasts, group limits, pruning)."""

from pyspark.sql import functions as F

from tabula.operators import cleaning, folds, vote
from tabula.plans import fixtures as fx
from tabula.plans import search
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_subset_scores_aggregates_before_shuffle(spark):
    p = fx.pred(spark, SF_SMALL)
    plan = _plan(vote.subset_scores(p, fx.RULE_MODELS, [0.4, 0.1, 0.3, 0.2], "y"))
    assert "partial_count" in plan and "partial_sum" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cleaning_needs_no_join(spark):
    ev = fx.table(spark, SF_SMALL, "events").select("event_id", "props", "event_type")
    plan = _plan(cleaning.clean_categorical(ev, ["props", "event_type"]))
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_folds_and_halves_move_no_rows(spark):
    train = fx.train(spark, SF_SMALL).select("id", "x_price")
    for df in (folds.kfold_contiguous(train, 5, ["id"]), folds.kfold_shuffled(train, 5, "id"), folds.head_fraction(train, 0.2, ["id"]), folds.split_halves(train, ["id"])):
        assert "Exchange" not in _plan(df)


def test_stratified_folds_move_no_rows(spark):
    train = fx.train(spark, SF_SMALL).select("id", "class")
    df = folds.kfold_stratified(train, 5, "class", ["id"])
    assert "Exchange" not in _plan(df) and "Join" not in _plan(df)


def test_top_trials_limits_groups_before_the_shuffle(spark):
    plan = _plan(search.top_trials(fx.trials(spark, SF_SMALL), k=3))
    assert "WindowGroupLimit" in plan


def test_fold_scan_reads_only_the_key_column(spark):
    ids = fx.train(spark, SF_SMALL).select("id")
    df = folds.kfold_contiguous(ids, 5, ["id"])
    df.count()
    plan = _plan(df)
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan or "struct<o_orderkey:bigint>" in plan


def test_hard_vote_is_narrow(spark):
    p = fx.table(spark, SF_SMALL, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 200000).cast("int").alias("a"),
        (F.month("o_orderdate") <= 6).cast("int").alias("b"),
    )
    plan = _plan(vote.vote_hard(p, {"a": 0.6, "b": 0.4}))
    assert "Exchange" not in plan


def test_knn_merge_limits_groups(spark):
    from tabula.operators.learners import knn_cosine

    e = fx.table(spark, SF_SMALL, "embeddings")
    q = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    r = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    assert "WindowGroupLimit" in _plan(knn_cosine(q, r, 5))


def test_no_query_builds_pairs(spark):
    import __spark_entry__ as E

    for name in sorted(E.oracle_sql()):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
