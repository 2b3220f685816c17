"""MLlib modelling surface (ML1-ML4): fingerprint bits -> sparse vectors ->
variance selection -> label scaling -> forest or linear model -> predictions in
the label's own units, as one pipeline that can be saved. Training runs
distributed in MLlib; nothing is collected except the fitted model."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, VarianceThresholdSelector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bits of a training table whose variance is not above this are left out
BIT_VARIANCE = 0.05


class _LabelParams(Params):
    labelCol = Param(Params._dummy(), "labelCol", "label whose mean and deviation are used", TypeConverters.toString)
    inputCol = Param(Params._dummy(), "inputCol", "column to scale", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "scaled column", TypeConverters.toString)
    inverse = Param(Params._dummy(), "inverse", "from scaled to own units", TypeConverters.toBoolean)


class LabelScaler(Estimator, _LabelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits mean and population deviation of a label. The model writes
    (input - mean) / std, or input * std + mean with ``inverse``. Null labels do
    not count; a constant label has deviation 1; without labels mean 0 and 1."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", inputCol: str = "label", outputCol: str = "scaled", inverse: bool = False):
        super().__init__()
        self._set(labelCol=labelCol, inputCol=inputCol, outputCol=outputCol, inverse=inverse)

    def _fit(self, dataset: DataFrame) -> LabelScalerModel:
        row = dataset.agg(F.avg(self.getOrDefault("labelCol")).alias("m"), F.stddev_pop(self.getOrDefault("labelCol")).alias("s")).first()
        return LabelScalerModel(mean=float(row["m"] or 0.0), std=float(row["s"] or 1.0), labelCol=self.getOrDefault("labelCol"),
                                inputCol=self.getOrDefault("inputCol"), outputCol=self.getOrDefault("outputCol"),
                                inverse=self.getOrDefault("inverse"))


class LabelScalerModel(Model, _LabelParams, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted :class:`LabelScaler`. A table without the input column (new rows
    have no label) passes through."""
    mean = Param(Params._dummy(), "mean", "label mean", TypeConverters.toFloat)
    std = Param(Params._dummy(), "std", "label deviation", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, mean: float = 0.0, std: float = 1.0, labelCol: str = "label", inputCol: str = "label",
                 outputCol: str = "scaled", inverse: bool = False):
        super().__init__()
        self._set(mean=mean, std=std, labelCol=labelCol, inputCol=inputCol, outputCol=outputCol, inverse=inverse)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mean, std, x = self.getOrDefault("mean"), self.getOrDefault("std"), self.getOrDefault("inputCol")
        if x not in dataset.columns:
            return dataset
        out = F.col(x) * std + mean if self.getOrDefault("inverse") else (F.col(x) - mean) / std
        return dataset.withColumn(self.getOrDefault("outputCol"), out)


def bit_rows(rows: DataFrame, bits: DataFrame, key: str = "mol_id") -> DataFrame:
    """``rows`` with ``bits``: the sorted on-bits of a molecule as strings (at
    most the fingerprint's width); a molecule without any has none."""
    on = bits.groupBy(key).agg(F.array_sort(F.collect_set("bit")).alias("_on"))
    names = F.transform(F.coalesce("_on", F.array().cast("array<bigint>")), lambda b: b.cast("string"))
    return rows.join(on, key, "left").withColumn("bits", names).drop("_on")


def vectorizer(spark, n_bits: int) -> CountVectorizerModel:
    """On-bits -> sparse 0/1 vector; slot i is bit i."""
    return CountVectorizerModel.from_vocabulary([str(i) for i in range(n_bits)], "bits", "raw").setBinary(True)


def potency_pipeline(spark, kind: str = "forest", n_bits: int = 2048, label: str = "pic50", seed: int = 41,
                     num_trees: int = 20, threshold: float = BIT_VARIANCE) -> Pipeline:
    """Vectors, selection on the raw bits' variance, label scaling, the model on
    the scaled label, and its prediction back in the label's units (``pred``)."""
    common = {"featuresCol": "features", "labelCol": "scaled_label", "predictionCol": "scaled_pred"}
    model = (RandomForestRegressor(**common, numTrees=num_trees, seed=seed, maxDepth=8) if kind == "forest"
             else LinearRegression(**common, regParam=0.01))
    return Pipeline(stages=[
        vectorizer(spark, n_bits),
        VarianceThresholdSelector(featuresCol="raw", outputCol="features", varianceThreshold=threshold),
        LabelScaler(labelCol=label, inputCol=label, outputCol="scaled_label"),
        model,
        LabelScaler(labelCol=label, inputCol="scaled_pred", outputCol="pred", inverse=True),
    ])


def kept_bits(model: PipelineModel) -> list[int]:
    """The bits that the selector kept, in order."""
    return list(model.stages[1].selectedFeatures)


def label_stats(model: PipelineModel) -> tuple[float, float]:
    """Mean and deviation of the training label."""
    scaler = model.stages[2]
    return scaler.getOrDefault("mean"), scaler.getOrDefault("std")


def batch_predict(model: PipelineModel, rows: DataFrame, key: str = "mol_id") -> DataFrame:
    """(key, pred) of a whole table of on-bits, labelled or not."""
    return model.transform(rows).select(key, "pred")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
