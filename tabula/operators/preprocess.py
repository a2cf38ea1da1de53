"""Leak-free preprocessing as Spark ML stages.

``build_preprocessing`` walks the input schema once and returns a plain
``pyspark.ml.Pipeline``:

    [column selection] -> mean imputation + population scaling (numeric, one
    fused pass) -> constant 'dna' imputation (SQLTransformer) -> drop-first one-hot
    (StringIndexer alphabetAsc + OneHotEncoder + VectorSlicer) -> VectorAssembler
    -> [classifier]

All statistics are learned by ``fit`` on the rows it is given (the training
fold) and applied unchanged by ``transform`` (any rows). Every stage is a
built-in JVM stage except the numeric imputer-scaler, whose fitted means /
stds are plain params (persisted by ``DefaultParamsWriter``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.functions.exprs import MISSING_CATEGORY, backtick
from tabula.plans.search import space_for

def strings_allowed(model_name: str | None, allow_strings: bool | None) -> bool:
    """Whether text columns may reach the model unencoded (T8 rule). Every family of the
    search spaces reads one numeric vector; another model may take text unless told not to."""
    if model_name is None:
        return bool(allow_strings)
    try:
        family = space_for(model_name)
    except ValueError:
        return True
    if allow_strings:
        raise ValueError(f"{family} learners read numbers: encode the text columns of {model_name!r}")
    return False


# ------------------------------------------------------------------ T3 scaler
class _ScalerParams(HasInputCols, HasOutputCols):
    means = Param(Params._dummy(), "means", "fitted means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population stds", typeConverter=TypeConverters.toListFloat)


class PopulationScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """``(x - mean) / std`` with the POPULATION std; a constant column maps to 0.
    Fit = one aggregate pass for all columns."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        aggs = []
        for c in cols:
            aggs += [F.avg(c).alias(f"m{len(aggs)}"), F.stddev_pop(c).alias(f"s{len(aggs) + 1}")]
        row = df.agg(*aggs).first() if cols else []
        means = [float(row[2 * i] or 0.0) for i in range(len(cols))]
        stds = [float(row[2 * i + 1] or 0.0) for i in range(len(cols))]
        m = PopulationScalerModel(inputCols=cols, outputCols=self.getOutputCols())
        return m._set(means=means, stds=stds)


class PopulationScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, o, m, s in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("means"), self.getOrDefault("stds")):
            scale = s if s != 0.0 else 1.0
            out = out.withColumn(o, (F.col(c).cast("double") - F.lit(m)) / F.lit(scale))
        return out


class MeanImputeScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """T1 + T3 fused: NULL -> training mean, then ``(x - mean) / std`` with the
    population std of the IMPUTED column. One aggregate pass gives both: imputed
    values sit at the mean, so they add nothing to the squared deviations and
    ``var_imputed = var_pop(non-null) * count(non-null) / count(*)``."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MeanImputeScalerModel:
        cols = self.getInputCols()
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.count(x).alias(f"k{i}")]
        row = df.agg(*aggs).first()
        n = row["n"] or 0
        means, stds = [], []
        for i in range(len(cols)):
            m, v, k = row[f"m{i}"], row[f"v{i}"], row[f"k{i}"]
            means.append(float(m) if m is not None else 0.0)
            stds.append(float((v * k / n) ** 0.5) if (v is not None and n) else 0.0)
        model = MeanImputeScalerModel(inputCols=cols, outputCols=self.getOutputCols())
        return model._set(means=means, stds=stds)


class MeanImputeScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, o, m, s in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("means"), self.getOrDefault("stds")):
            scale = s if s != 0.0 else 1.0
            x = F.coalesce(F.col(c).cast("double"), F.lit(m))
            out = out.withColumn(o, (x - F.lit(m)) / F.lit(scale))
        return out


# ------------------------------------------------------------------ T5 one-hot
class DropFirstOneHot(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot with the first (alphabetically smallest) category dropped;
    unseen categories encode as all zeros. ``fit`` returns a PipelineModel of
    built-in stages (StringIndexer -> OneHotEncoder -> VectorSlicer per column),
    writing ``<col>_ohe``."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        cols = self.getInputCols()
        idx_cols = [f"{c}__idx" for c in cols]
        oh_cols = [f"{c}__oh" for c in cols]
        indexer = StringIndexer(inputCols=cols, outputCols=idx_cols, stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
        # sizes come from the indexer's label metadata (no data pass)
        encoder = OneHotEncoder(inputCols=idx_cols, outputCols=oh_cols, dropLast=False).fit(indexer.transform(df.limit(0)))
        stages: list[Transformer] = [indexer, encoder]
        for c, o, labels in zip(cols, oh_cols, indexer.labelsArray):
            k = len(labels)
            if k >= 2:
                stages.append(VectorSlicer(inputCol=o, outputCol=f"{c}_ohe", indices=list(range(1, k))))
        return PipelineModel(stages)


def one_hot_labels(model: PipelineModel) -> dict[str, list[str]]:
    """Kept category names per column of a fitted :class:`DropFirstOneHot`."""
    indexer = model.stages[0]
    return {c: list(labels[1:]) for c, labels in zip(indexer.getInputCols(), indexer.labelsArray) if len(labels) >= 2}


# ------------------------------------------------------------------ T8 pipeline
def split_columns(schema: T.StructType, features_in: Sequence[str] | None, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    fields = {f.name: f for f in schema.fields}
    names = list(features_in) if features_in is not None else [f.name for f in schema.fields if f.name not in exclude]
    missing = [n for n in names if n not in fields]
    if missing:
        raise ValueError(f"missing features: {missing}")
    num = [n for n in names if isinstance(fields[n].dataType, T.NumericType)]
    cat = [n for n in names if isinstance(fields[n].dataType, T.StringType)]
    return num, cat


def build_preprocessing(
    schema: T.StructType,
    features_in: Sequence[str] | None = None,
    model: Estimator | None = None,
    allow_strings: bool | None = None,
    enforce_input_dataframe: bool = False,
    exclude: Sequence[str] = (),
    features_col: str = "features",
    keep: Sequence[str] = (),
    model_name: str | None = None,
) -> Pipeline:
    """The preprocessing (and optional model) pipeline for a schema.
    ``model_name`` names the learner family for the string rule; every Spark
    ML classifier counts as numeric-only."""
    if enforce_input_dataframe and features_in is not None:
        raise ValueError("features_in picks columns, enforce_input_dataframe takes them all: give one of the two")
    num, cat = split_columns(schema, features_in, exclude)
    if model is not None and model_name is None:
        model_name = "ridge"
    keep_strings = strings_allowed(model_name, allow_strings)
    if model is not None:
        keep_strings = False  # Spark ML classifiers read one numeric vector
    stages: list = []
    if num:
        stages.append(MeanImputeScaler(inputCols=num, outputCols=[f"{c}_scaled" for c in num]))
    if cat:
        fills = ", ".join(f"coalesce({backtick(c)}, '{MISSING_CATEGORY}') AS {backtick(c + '__str')}" for c in cat)
        stages.append(SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"))
    if keep_strings:
        # T9 pass-through: scaled numerics + imputed raw strings, one column per input
        outs = ", ".join(
            [backtick(k) for k in keep]
            + [f"{backtick(c + '_scaled')} AS {backtick(c)}" for c in num]
            + [f"{backtick(c + '__str')} AS {backtick(c)}" for c in cat]
        )
        stages.append(SQLTransformer(statement=f"SELECT {outs} FROM __THIS__"))
    else:
        if cat:
            stages.append(DropFirstOneHot(inputCols=[f"{c}__str" for c in cat]))
        stages.append(_LazyAssembler(numCols=[f"{c}_scaled" for c in num], catCols=[f"{c}__str" for c in cat], outputCol=features_col))
    if model is not None:
        stages.append(model)
    return Pipeline(stages=stages)


class _LazyAssembler(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """VectorAssembler over the numeric block then the one-hot block; a
    categorical column with a single category contributes no slot."""

    numCols = Param(Params._dummy(), "numCols", "numeric inputs", typeConverter=TypeConverters.toListString)
    catCols = Param(Params._dummy(), "catCols", "categorical inputs", typeConverter=TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "output column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numCols=None, catCols=None, outputCol="features"):
        super().__init__()
        self._setDefault(numCols=[], catCols=[], outputCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        present = set(df.columns)
        ins = list(self.getOrDefault("numCols")) + [f"{c}_ohe" for c in self.getOrDefault("catCols") if f"{c}_ohe" in present]
        return VectorAssembler(inputCols=ins, outputCol=self.getOrDefault("outputCol"), handleInvalid="keep").transform(df)


def feature_names(fitted: PipelineModel, schema: T.StructType, features_in: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the assembled slots: numeric columns, then ``<col>_<category>``."""
    num, cat = split_columns(schema, features_in, exclude)
    names = list(num)
    for st in fitted.stages:
        if isinstance(st, PipelineModel) and st.stages and isinstance(st.stages[0], StringIndexerModel):
            labels = one_hot_labels(st)
            for c in cat:
                names += [f"{c}_{v}" for v in labels.get(f"{c}__str", [])]
    return names


def dense_named(df: DataFrame, names: Sequence[str], keep: Sequence[str] = (), features_col: str = "features") -> DataFrame:
    """The assembled vector as dense named double columns."""
    arr = vector_to_array(F.col(features_col))
    return df.select(*keep, *[arr[i].alias(n) for i, n in enumerate(names)])


def features_long(df: DataFrame, names: Sequence[str], id_col: str, features_col: str = "features") -> DataFrame:
    """The assembled vector as ``(id, slot, feature, value)`` rows."""
    nm = F.array(*[F.lit(n) for n in names])
    return df.select(id_col, F.posexplode(vector_to_array(F.col(features_col))).alias("slot", "value")).select(
        id_col, F.col("slot").cast("int").alias("slot"), F.element_at(nm, F.col("slot") + 1).alias("feature"), "value"
    )
