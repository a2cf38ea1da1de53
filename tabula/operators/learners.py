"""Distributed learners.

* L1 ridge classifier: one pass computes the Gram matrix ``[X 1]^T [X 1]`` and
  ``[X 1]^T y`` (per-partition numpy partials summed by a groupBy), so every
  ``alpha`` is solved from the same small ``(d+1)^2`` table.
* L2-L4 boosted trees: ``GBTClassifier`` profiles for the three boosting
  libraries' parameter spaces; L7 ``RandomForestClassifier``; L6 linear
  ``LinearSVC`` (other kernels have no distributed counterpart).
* L5 AdaBoost (SAMME): :mod:`tabula.operators.boosting`.
* L8 cosine k-NN, exact: queries and references are hashed into blocks;
  every (query block, reference block) pair meets in one cogroup task where
  numpy scores the block product and keeps the top k per query; a final
  partial-limited window merges the per-block top k. Data moved is
  ``nq * B + nr * Q`` rows, never the ``nq * nr`` pairs.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabula.operators.boosting import AdaBoostSAMME
from tabula.operators.stopping import StoppedBoostedTrees
from tabula.plans.search import space_for
from tabula.session import checkpointed


# ------------------------------------------------------------------ L1 ridge
MERGE_GROUPS = 64


def gram_matrix(df: DataFrame, features_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """``(A, b, n)`` with ``A = [X 1]^T [X 1]``, ``b = [X 1]^T y`` from one
    distributed pass: each partition packs its partial ``A`` and ``b`` into ONE
    vector, and ``Summarizer.sum`` adds them in two levels, so the
    shuffle carries one row per partition and only ``(d+1)^2 + (d+1)`` numbers
    reach the driver."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    x = df.select(vector_to_array(F.col(features_col)).alias("x"), F.col(label_col).cast("double").alias("y"))

    def partial(it):
        acc = None
        for pdf in it:
            if len(pdf) == 0:
                continue
            xm = np.vstack(pdf["x"].to_numpy())
            x1 = np.hstack([xm, np.ones((xm.shape[0], 1))])
            packed = np.concatenate([(x1.T @ x1).ravel(), x1.T @ pdf["y"].to_numpy()])
            acc = packed if acc is None else acc + packed
        if acc is not None:
            yield pd.DataFrame({"v": [acc.tolist()]})

    packed = x.mapInPandas(partial, "v array<double>").select(array_to_vector("v").alias("v"))
    # partials are added in groups first: no task takes one vector from every partition
    groups = packed.withColumn("g", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(MERGE_GROUPS))).groupBy("g").agg(Summarizer.sum(F.col("v")).alias("v"))
    total = np.asarray(groups.agg(Summarizer.sum(F.col("v")).alias("s")).first()["s"].toArray())
    m = int(round((-1 + math.sqrt(1 + 4 * len(total))) / 2))  # len = m^2 + m
    a = total[: m * m].reshape(m, m)
    b = total[m * m :]
    return a, b, int(round(a[m - 1, m - 1]))


def ridge_solve(a: np.ndarray, b: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge with an unpenalised intercept from the augmented normal equations."""
    m = a.shape[0]
    reg = np.eye(m) * alpha
    reg[m - 1, m - 1] = 0.0
    sol = np.linalg.solve(a + reg, b)
    return sol[: m - 1], float(sol[m - 1])


class _RidgeParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    alpha = Param(Params._dummy(), "alpha", "L2 strength", typeConverter=TypeConverters.toFloat)
    tol = Param(Params._dummy(), "tol", "unused by the direct solve", typeConverter=TypeConverters.toFloat)
    coefficients = Param(Params._dummy(), "coefficients", "fitted weights", typeConverter=TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "fitted intercept", typeConverter=TypeConverters.toFloat)


class RidgeClassifier(Estimator, _RidgeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Binary ridge classifier: ridge regression on ``y in {-1, +1}``,
    prediction = 1 when the score is positive."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", alpha=1.0, tol=1e-4):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", alpha=1.0, tol=1e-4)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> RidgeClassifierModel:
        return fit_ridges([self], df)[0]


def fit_ridges(estimators: Sequence[RidgeClassifier], df: DataFrame) -> list[RidgeClassifierModel]:
    """Ridge classifiers that differ in ``alpha`` only, all from one pass over the data."""
    first = estimators[0]
    signed = df.select(first.getFeaturesCol(), (F.col(first.getLabelCol()) * 2 - 1).alias("__y"))
    a, b, _ = gram_matrix(signed, first.getFeaturesCol(), "__y")
    out = []
    for est in estimators:
        w, c = ridge_solve(a, b, est.getOrDefault("alpha"))
        m = RidgeClassifierModel(featuresCol=est.getFeaturesCol(), predictionCol=est.getPredictionCol())
        out.append(m._set(coefficients=[float(v) for v in w], intercept=c, alpha=est.getOrDefault("alpha")))
    return out


class RidgeClassifierModel(Model, _RidgeParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def decision(self, features: F.Column) -> F.Column:
        coef = F.array(*[F.lit(float(v)) for v in self.getOrDefault("coefficients")])
        arr = vector_to_array(features)
        dot = F.aggregate(F.zip_with(arr, coef, lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v)
        return dot + F.lit(self.getOrDefault("intercept"))

    def _transform(self, df: DataFrame) -> DataFrame:
        score = self.decision(F.col(self.getFeaturesCol()))
        return df.withColumn("rawPrediction", score).withColumn(
            self.getPredictionCol(), F.when(F.col("rawPrediction") > 0, 1.0).otherwise(0.0)
        )


# ------------------------------------------------------------------ L6 linear SVC
class LinearSVCByCost(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """``LinearSVC`` with the usual cost ``C`` per row: ``regParam = 1 / (C * rows)``, the
    rows being those it is fitted on."""

    C = Param(Params._dummy(), "C", "cost of a margin violation", typeConverter=TypeConverters.toFloat)
    tol = Param(Params._dummy(), "tol", "tolerance", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, tol=1e-6):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, tol=1e-6)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cost = self.getOrDefault("C") * max(df.count(), 1)
        svc = LinearSVC(regParam=1.0 / cost, tol=self.getOrDefault("tol"), standardization=False, featuresCol=self.getFeaturesCol(),
                        labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol())
        return svc.fit(df)


# ------------------------------------------------------------------ L2-L7 profiles
def _subset_strategy(frac: float | None) -> str:
    if frac is None or frac >= 1.0:
        return "all"
    return repr(_share("column share", frac))


def _share(name: str, value: object) -> float:
    v = float(value)
    if not 0.0 < v <= 1.0:
        raise ValueError(f"{name} must lie in (0, 1], not {v}")
    return v


def _tree_depth(value: object) -> int:
    if int(value) > 30:
        raise ValueError(f"trees are at most 30 deep, not {value}")
    return int(value)


def make_learner(model_name: str, params: Mapping[str, object] | None = None, seed: int = 42,
                 features_col: str = "features", label_col: str = "label") -> Estimator:
    """Spark estimator for a reference model name and its search parameters."""
    p = dict(params or {})
    kind = space_for(model_name)
    common = {"featuresCol": features_col, "labelCol": label_col}
    if kind == "ridge":
        return RidgeClassifier(alpha=float(p.get("alpha", 1.0)), tol=float(p.get("tol", 1e-4)), **common)
    if kind == "randomforest":
        mf = p.get("max_features", "sqrt")
        return RandomForestClassifier(
            numTrees=int(p.get("n_estimators", 100)),
            maxDepth=_tree_depth(p.get("max_depth", 5)),
            # a node of two children of the least leaf size has at least twice that many rows
            minInstancesPerNode=max(int(p.get("min_samples_leaf", 1)), -(-int(p.get("min_samples_split", 2)) // 2)),
            featureSubsetStrategy={None: "all", "None": "all"}.get(mf, mf),
            seed=seed,
            **common,
        )
    if kind == "svc":
        kernel = p.get("kernel", "linear")
        if kernel != "linear":
            raise NotImplementedError(f"kernel {kernel!r}: only the linear kernel has a distributed solver")
        return LinearSVCByCost(C=float(p.get("C", 1.0)), tol=float(p.get("tol", 1e-6)), **common)
    if kind == "kneighbors":
        return KNNCosineClassifier(k=int(p.get("n_neighbors", 5)), weights=str(p.get("weights", "uniform")), search=str(p.get("search", "exact")), **common)
    if kind == "adaboost":
        return AdaBoostSAMME(rounds=int(p.get("n_estimators", 50)), learningRate=float(p.get("learning_rate", 1.0)), seed=seed, **common)
    # boosted trees: xgb / lgbm / catboost profiles
    if kind == "catboost":
        iters, depth = p.get("iterations", 100), p.get("depth", 6)
        frac = p.get("rsm", 1.0)
        bins = int(p.get("border_count", 32))
        wait, positive = int(p.get("od_wait") or 0), float(p.get("scale_pos_weight") or 1.0)
        if wait > 0 or positive != 1.0:
            return StoppedBoostedTrees(
                maxIter=int(iters), maxDepth=_tree_depth(depth), stepSize=_share("learning_rate", p.get("learning_rate", 0.1)),
                subsamplingRate=_share("subsample", p.get("subsample", 1.0)), featureSubsetStrategy=_subset_strategy(float(frac) if frac is not None else None),
                maxBins=max(bins, 2), seed=seed, wait=wait, positiveWeight=positive, **common,
            )
    else:
        iters, depth = p.get("n_estimators", 100), p.get("max_depth", 5)
        frac = p.get("colsample_bytree", 1.0)
        bins = 32
    return GBTClassifier(
        maxIter=int(iters),
        maxDepth=_tree_depth(depth),
        stepSize=_share("learning_rate", p.get("learning_rate", 0.1)),
        subsamplingRate=_share("subsample", p.get("subsample", 1.0)),
        featureSubsetStrategy=_subset_strategy(float(frac) if frac is not None else None),
        # a child's weight is a sum of hessians, at most 1/4 a row here: so many rows it has at least
        minInstancesPerNode=max(1, math.ceil(float(p.get("min_child_weight", 0.0)))),
        minInfoGain=float(p.get("gamma", 0.0)) if kind == "xgb" else 0.0,
        maxBins=max(bins, 2),
        seed=seed,
        **common,
    )


# ------------------------------------------------------------------ L8 k-NN
KNN_BLOCK_ROWS = 20_000
KNN_TILE_ROWS = 256


def knn_cosine(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "vec",
    label_col: str = "label",
    query_blocks: int | None = None,
    ref_blocks: int | None = None,
    block_rows: int = KNN_BLOCK_ROWS,
) -> DataFrame:
    """Exact cosine k nearest references per query: ``(qid, rid, sim, label, rank)``.
    Ties in similarity go to the smaller reference id.

    Block counts follow the data (``ceil(rows / block_rows)``), so one cogroup
    task holds at most about ``2 * block_rows`` rows at any table size."""
    if query_blocks is None or ref_blocks is None:
        counts = queries.select(F.count(F.lit(1))).first()[0], refs.select(F.count(F.lit(1))).first()[0]
    qb = query_blocks or max(1, math.ceil(counts[0] / block_rows))
    rb = ref_blocks or max(1, math.ceil(counts[1] / block_rows))
    q = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("qv"))
    r = refs.select(F.col(id_col).alias("rid"), F.col(vec_col).cast("array<double>").alias("rv"), F.col(label_col).alias("rlabel"))
    q = q.withColumn("__qb", F.pmod(F.xxhash64("qid"), F.lit(qb))).withColumn("__rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1))))
    r = r.withColumn("__rb", F.pmod(F.xxhash64("rid"), F.lit(rb))).withColumn("__qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    label_type = refs.schema[label_col].dataType.simpleString()

    def block_topk(qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({"qid": [], "rid": [], "sim": [], "label": []})
        qm = np.vstack(qpdf["qv"].to_numpy())
        rm = np.vstack(rpdf["rv"].to_numpy())
        qn = np.linalg.norm(qm, axis=1)
        rn = np.linalg.norm(rm, axis=1)
        rid = rpdf["rid"].to_numpy()
        kk = min(k, len(rid))
        rows, cols, vals = [], [], []
        for lo in range(0, len(qm), KNN_TILE_ROWS):  # a tile of the product at a time
            sims = (qm[lo : lo + KNN_TILE_ROWS] @ rm.T) / np.outer(qn[lo : lo + KNN_TILE_ROWS], rn)
            sims = np.where(np.isnan(sims), -np.inf, sims)  # a zero vector is near nothing
            least = np.partition(sims, len(rid) - kk, axis=1)[:, len(rid) - kk]
            r, c = np.nonzero(sims >= least[:, None])  # the k nearest and whatever ties with the last
            order = np.lexsort((rid[c], -sims[r, c], r))
            r, c = r[order], c[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < kk
            rows.append(r[first] + lo)
            cols.append(c[first])
            vals.append(sims[r[first], c[first]])
        r, c = np.concatenate(rows), np.concatenate(cols)
        return pd.DataFrame({"qid": qpdf["qid"].to_numpy()[r], "rid": rid[c], "sim": np.concatenate(vals), "label": rpdf["rlabel"].to_numpy()[c]})

    cand = q.groupBy("__qb", "__rb").cogroup(r.groupBy("__qb", "__rb")).applyInPandas(
        block_topk, f"qid long, rid long, sim double, label {label_type}"
    )
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), F.col("rid").asc())
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _neighbour_weight(weights: str) -> F.Column:
    return F.lit(1.0) if weights == "uniform" else F.lit(1.0) / F.greatest(F.lit(1e-12), F.lit(1.0) - F.col("sim"))


def knn_vote(neigh: DataFrame, weights: str = "uniform") -> DataFrame:
    """Label per query from its neighbours: uniform or 1/distance weights
    (distance = 1 - cosine similarity); ties -> smallest label."""
    mass = neigh.groupBy("qid", "label").agg(F.sum(_neighbour_weight(weights)).alias("mass"))
    w = Window.partitionBy("qid").orderBy(F.col("mass").desc(), F.col("label").asc())
    return mass.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("qid", F.col("label").alias("prediction"))


class _KNNParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    k = Param(Params._dummy(), "k", "neighbours", typeConverter=TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", typeConverter=TypeConverters.toString)
    search = Param(Params._dummy(), "search", "exact, or lsh for most of the neighbours at less than quadratic cost", typeConverter=TypeConverters.toString)


_KNN_DEFAULTS = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction", "k": 5, "weights": "uniform", "search": "exact"}


class KNNCosineClassifier(Estimator, _KNNParams, DefaultParamsReadable, DefaultParamsWritable):
    """Lazy learner: ``fit`` keeps the (checkpointed) reference rows; ``transform``
    searches them, exactly or by hashes. Rows need an ``id`` column."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", k=5, weights="uniform", search="exact"):
        super().__init__()
        self._setDefault(**_KNN_DEFAULTS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> KNNCosineModel:
        refs = df.select("id", vector_to_array(F.col(self.getFeaturesCol())).alias("vec"), F.col(self.getLabelCol()).cast("double").alias("label"))
        own = {p: self.getOrDefault(p) for p in ("featuresCol", "predictionCol", "k", "weights", "search")}
        return KNNCosineModel(checkpointed(refs), **own)


class KNNCosineModel(Model, _KNNParams, MLReadable, MLWritable):
    """The reference rows ``(id, vec, label)``, saved with the model as a table; ``probability`` holds
    the neighbours' shares of the classes 0 and 1. A row without a neighbour gets nulls."""

    def __init__(self, refs: DataFrame | None = None, **params: object):
        super().__init__()
        self._setDefault(**_KNN_DEFAULTS, probabilityCol="probability")
        self._set(**params)
        self.refs = refs

    def neighbours(self, queries: DataFrame) -> DataFrame:
        search = self.getOrDefault("search")
        if search == "exact":
            return knn_cosine(queries, self.refs, self.getOrDefault("k"))
        if search != "lsh":
            raise ValueError(f"search must be exact or lsh, not {search!r}")
        from tabula.operators.lsh import knn_cosine_lsh

        return knn_cosine_lsh(queries, self.refs, self.getOrDefault("k"))

    def _transform(self, df: DataFrame) -> DataFrame:
        near = self.neighbours(df.select("id", vector_to_array(F.col(self.getFeaturesCol())).alias("vec")))
        weight = _neighbour_weight(self.getOrDefault("weights"))
        mass = near.groupBy("qid").agg(F.sum(F.when(F.col("label") > 0, weight).otherwise(0.0)).alias("one"), F.sum(weight).alias("all"))
        p = F.col("one") / F.col("all")
        votes = mass.select(
            F.col("qid").alias("id"),
            array_to_vector(F.array(F.lit(1.0) - p, p)).alias(self.getProbabilityCol()),
            F.when(2 * F.col("one") > F.col("all"), 1.0).otherwise(0.0).alias(self.getPredictionCol()),
        )
        return df.join(votes, "id", "left")

    def write(self) -> MLWriter:
        return _KNNWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KNNReader(cls)


class _KNNWriter(MLWriter):
    def __init__(self, instance: KNNCosineModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.refs.write.parquet(f"{path}/refs")


class _KNNReader(MLReader):
    def __init__(self, cls: type[KNNCosineModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> KNNCosineModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/refs"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def learner_family(model_name: str) -> str:
    return space_for(model_name)


def default_models() -> Sequence[str]:
    """Model names of the reference's search catalogue."""
    return ("RidgeClassifier", "XGBClassifier", "LGBMClassifier", "CatBoostClassifier", "RandomForestClassifier",
            "KNeighborsClassifier", "SVC", "AdaBoostClassifier")
