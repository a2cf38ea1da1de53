"""Boosted trees that stop on held-out rows and weigh the positive class (L4).

A seeded hash of the row key holds a share of the training rows back. The trees are
fitted on the others; the loss after each tree is measured on the held-out rows in one
job; training counts as stopped once ``wait`` further trees brought no improvement, and
the model is cut to its best number of trees. Boosting is sequential and seeded, so the
cut model is a refit with that many trees on the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT_SHARE = 0.1


def best_count(losses: Sequence[float], wait: int) -> int:
    """Trees of the best model seen before ``wait`` trees in a row didn't improve on it."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= wait:
            break
    return best + 1


class StoppedBoostedTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """``GBTClassifier`` with a positive-class weight and, for ``wait`` > 0, early stopping.
    Rows are held out by their ``id`` where there is one, else by their features. Without
    held-out or training rows on either side it doesn't stop early."""

    maxIter = Param(Params._dummy(), "maxIter", "most trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "tree depth", typeConverter=TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", typeConverter=TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "row share of a tree", typeConverter=TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "columns of a split", typeConverter=TypeConverters.toString)
    maxBins = Param(Params._dummy(), "maxBins", "bins", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of trees and held-out rows", typeConverter=TypeConverters.toInt)
    wait = Param(Params._dummy(), "wait", "trees without improvement before stopping, 0: never", typeConverter=TypeConverters.toInt)
    positiveWeight = Param(Params._dummy(), "positiveWeight", "weight of a row of class 1", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=100, maxDepth=6, stepSize=0.1,
                 subsamplingRate=1.0, featureSubsetStrategy="all", maxBins=32, seed=42, wait=0, positiveWeight=1.0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=100, maxDepth=6, stepSize=0.1,
                         subsamplingRate=1.0, featureSubsetStrategy="all", maxBins=32, seed=42, wait=0, positiveWeight=1.0)
        self._set(**self._input_kwargs)

    def held_out(self, df: DataFrame) -> Column:
        key = F.col("id") if "id" in df.columns else F.hash(vector_to_array(F.col(self.getFeaturesCol())))
        return F.pmod(F.xxhash64(F.lit(self.getOrDefault("seed")), key), F.lit(1000)) < int(1000 * HELD_OUT_SHARE)

    def _trees(self, count: int) -> GBTClassifier:
        same = ("featuresCol", "labelCol", "predictionCol", "maxDepth", "stepSize", "subsamplingRate", "featureSubsetStrategy", "maxBins", "seed")
        return GBTClassifier(maxIter=count, weightCol="__weight", **{p: self.getOrDefault(p) for p in same})

    def _fit(self, df: DataFrame) -> GBTClassificationModel:
        most, wait = self.getOrDefault("maxIter"), self.getOrDefault("wait")
        positive = F.col(self.getLabelCol()) > 0
        rows = df.withColumn("__weight", F.when(positive, F.lit(self.getOrDefault("positiveWeight"))).otherwise(F.lit(1.0)))
        if wait <= 0:
            return self._trees(most).fit(rows)
        rows = rows.withColumn("__held", self.held_out(df)).persist()
        train, held = rows.where("not __held"), rows.where("__held")
        if held.isEmpty() or train.isEmpty():
            model = self._trees(most).fit(rows)
        else:
            model = self._trees(most).fit(train)
            count = best_count(model.evaluateEachIteration(held), wait)
            if count < most:
                model = self._trees(count).fit(train)
        rows.unpersist()
        return model
