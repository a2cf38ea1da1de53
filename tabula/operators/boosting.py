"""AdaBoost (SAMME) whose fitted trees are one small table.

Fitting is a driver loop of weighted tree fits; the weight column is updated with
column expressions and the lineage is cut by ``checkpoint()`` every round. The
fitted trees are flattened into a table with one row per tree and arrays of nodes
(:data:`NODES`). That table is what the model saves and loads, and it scores a
batch of rows with one gather per tree level, so the plan of a prediction is
the same for one round and for five hundred. Its size is bounded by the rounds and
the depth (``rounds * 2^(depth + 1)`` nodes), never by the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.session import checkpointed

NODES = (
    "tree int, weight double, feature array<int>, threshold array<double>, categories array<array<double>>, "
    "left array<int>, right array<int>, value array<double>"
)
"""One row per tree, in fitting order; node 0 is the root, a leaf has feature -1 and is its own
child; ``categories`` (null for a threshold) are the values that go left."""


def samme_alpha(err: F.Column | float, learning_rate: float, n_classes: int = 2):
    """SAMME stage weight ``lr * (ln((1-err)/err) + ln(K-1))``."""
    if isinstance(err, (int, float)):
        return learning_rate * (math.log((1 - err) / err) + math.log(n_classes - 1))
    return F.lit(learning_rate) * (F.log((F.lit(1.0) - err) / err) + F.lit(math.log(n_classes - 1)))


def samme_reweight(df: DataFrame, miss_col: str, weight_col: str, learning_rate: float, n_classes: int = 2) -> DataFrame:
    """One SAMME step on a table with a 0/1 miss column: returns rows with the
    new normalised weight plus the step's ``err`` and ``alpha`` (two one-row
    aggregates; the row data stays distributed)."""
    err = df.select((F.sum(F.col(weight_col) * F.col(miss_col)) / F.sum(weight_col)).alias("e")).first()["e"]
    alpha = samme_alpha(err, learning_rate, n_classes)
    neww = F.col(weight_col) * F.exp(F.lit(alpha) * F.col(miss_col))
    total = df.select(F.sum(neww).alias("t")).first()["t"]
    return df.withColumn(weight_col, neww / F.lit(total)).withColumn("err", F.lit(err)).withColumn("alpha", F.lit(alpha))


def tree_row(index: int, weight: float, tree: DecisionTreeClassificationModel) -> tuple:
    """A fitted tree as a row of :data:`NODES`."""
    nodes: list[list] = []
    todo = [tree._java_obj.rootNode()]
    while todo:  # nodes get their numbers level by level
        node, k = todo.pop(0), len(nodes)
        if node.getClass().getSimpleName() == "LeafNode":
            nodes.append([-1, 0.0, None, k, k, node.prediction()])
            continue
        split = node.split()
        below = k + 1 + len(todo)  # the children queue up behind what waits already
        if split.getClass().getSimpleName() == "CategoricalSplit":
            nodes.append([split.featureIndex(), 0.0, [float(c) for c in split.leftCategories()], below, below + 1, 0.0])
        else:
            nodes.append([split.featureIndex(), split.threshold(), None, below, below + 1, 0.0])
        todo += [node.leftChild(), node.rightChild()]
    return (index, float(weight), *(list(c) for c in zip(*nodes, strict=True)))


class NodeTable:
    """All trees' nodes in flat arrays; scores rows in numpy."""

    def __init__(self, rows: Sequence[tuple]):
        sizes = [len(r[2]) for r in rows]
        self.root = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if rows else np.zeros(0, np.int64)
        flat = lambda k: [v for r in rows for v in r[k]]
        shift = np.repeat(self.root, sizes)
        self.weight = np.array([r[1] for r in rows])
        self.feature, self.threshold, self.value = np.array(flat(2), np.int64), np.array(flat(3), float), np.array(flat(7), float)
        self.left, self.right = (np.array(flat(k), np.int64) + shift for k in (5, 6))
        sets = flat(4)
        # a node with a set of categories looks its value up in a row of flags
        self.which = np.array([-1 if s is None else i for i, s in enumerate(sets)], np.int64)
        width = int(max((max(s, default=0) for s in sets if s is not None), default=0)) + 1
        self.goes = np.zeros((sum(s is not None for s in sets), width), bool)
        for k, i in enumerate(np.flatnonzero(self.which >= 0)):
            self.goes[k, np.array(sets[i], np.int64)] = True
            self.which[i] = k
        self.depth = self._depth()

    def _depth(self) -> int:
        at, levels = self.root, 0
        while (self.feature[at] >= 0).any():
            inner = np.unique(at[self.feature[at] >= 0])
            at = np.concatenate([self.left[inner], self.right[inner]])
            levels += 1
        return levels

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Mean vote in [-1, 1] of each row, trees weighted: above 0 means class 1."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for root, weight in zip(self.root, self.weight, strict=True):
            at = np.full(len(x), root)
            for _ in range(self.depth):
                value = x[every, np.maximum(self.feature[at], 0)]
                left = value <= self.threshold[at]
                if len(self.goes):
                    known = np.clip(np.nan_to_num(value), 0, self.goes.shape[1] - 1).astype(np.int64)
                    member = self.goes[np.maximum(self.which[at], 0), known] & (known == value)
                    left = np.where(self.which[at] >= 0, member, left)
                at = np.where(left, self.left[at], self.right[at])
            total += weight * (2 * self.value[at] - 1)
        return total / self.weight.sum()


class _AdaParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", typeConverter=TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage", typeConverter=TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "base tree depth", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", typeConverter=TypeConverters.toInt)


class AdaBoostSAMME(Estimator, _AdaParams, DefaultParamsReadable, DefaultParamsWritable):
    """Binary AdaBoost (SAMME) of depth-limited trees."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", rounds=10, learningRate=1.0, maxDepth=3, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", rounds=10, learningRate=1.0, maxDepth=3, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> AdaBoostSAMMEModel:
        fc, lc = self.getFeaturesCol(), self.getLabelCol()
        lr = self.getOrDefault("learningRate")
        cur = df.select(fc, lc).withColumn("__w", F.lit(1.0))
        rows: list[tuple] = []
        for r in range(self.getOrDefault("rounds")):
            tree = DecisionTreeClassifier(featuresCol=fc, labelCol=lc, weightCol="__w", maxDepth=self.getOrDefault("maxDepth"),
                                          seed=self.getOrDefault("seed") + r).fit(cur)
            scored = tree.transform(cur).withColumn("__miss", (F.col("prediction") != F.col(lc)).cast("double"))
            err = scored.select((F.sum(F.col("__w") * F.col("__miss")) / F.sum("__w")).alias("e")).first()["e"]
            if err is None or err >= 0.5:
                if not rows:
                    raise ValueError(f"the first tree is no better than chance (weighted error {err})")
                break
            err = max(err, 1e-10)
            a = samme_alpha(err, lr)
            rows.append(tree_row(r, a, tree))
            if err <= 1e-10:
                break
            cur = checkpointed(scored.select(fc, lc, (F.col("__w") * F.exp(F.lit(a) * F.col("__miss"))).alias("__w")))
        return AdaBoostSAMMEModel(rows, featuresCol=fc, predictionCol=self.getPredictionCol())


class AdaBoostSAMMEModel(Model, _AdaParams, MLReadable, MLWritable):
    """The fitted trees as rows of :data:`NODES`; adds ``rawPrediction`` (the weighted mean vote),
    ``probability`` (``[1 - p, p]`` with ``p = 1 / (1 + exp(-2 * vote))``) and the prediction."""

    def __init__(self, rows: Sequence[tuple] = (), **params: str):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", probabilityCol="probability", rawPredictionCol="rawPrediction")
        self._set(**params)
        self.rows = [tuple(r) for r in rows]

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The trees as a table."""
        return spark.createDataFrame(self.rows, NODES)

    def _transform(self, df: DataFrame) -> DataFrame:
        table = NodeTable(self.rows)

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            return pd.Series(table.margin(np.vstack(x.to_numpy()))) if len(x) else pd.Series([], dtype=float)

        raw, out = self.getRawPredictionCol(), df.withColumn(self.getRawPredictionCol(), margin(vector_to_array(F.col(self.getFeaturesCol()))))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col(raw)))
        return out.withColumn(self.getProbabilityCol(), array_to_vector(F.array(F.lit(1.0) - p, p))).withColumn(
            self.getPredictionCol(), F.when(F.col(raw) > 0, 1.0).otherwise(0.0)
        )

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, instance: AdaBoostSAMMEModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.nodes(self.sparkSession).coalesce(1).write.parquet(f"{path}/nodes")


class _ModelReader(MLReader):
    def __init__(self, cls: type[AdaBoostSAMMEModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> AdaBoostSAMMEModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.schema(NODES).parquet(f"{path}/nodes").orderBy("tree").collect()  # one row per round
        model = self.cls([(r.tree, r.weight, r.feature, r.threshold, r.categories, r.left, r.right, r.value) for r in rows])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
