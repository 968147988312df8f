"""Scaling and selection of feature vectors as Spark ML steps: fitted on training rows only, saved with a pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators import scaling


def _long(rows: DataFrame, column: str, *more: Column) -> DataFrame:
    """(dim, x) of a vector column."""
    return rows.select(*more, F.posexplode(vector_to_array(column)).alias("dim", "x"))


class VectorScaler(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population deviation by dimension; a deviation of 0 counts as 1."""

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "scaled"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> VectorScalerModel:
        # one row a dimension, as the model itself has
        stats = _long(dataset, self.getInputCol()).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d")).orderBy("dim").collect()
        fitted = VectorScalerModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        return fitted._set(means=[r["m"] for r in stats], deviations=[r["d"] if r["d"] else 1.0 for r in stats])


class VectorScalerModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean of each dimension", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "deviation of each dimension", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "scaled"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        m, d = (F.array(*map(F.lit, self.getOrDefault(p))) for p in (self.means, self.deviations))
        x = vector_to_array(self.getInputCol())
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.transform(F.arrays_zip(x.alias("x"), m.alias("m"), d.alias("d")), lambda v: (v["x"] - v["m"]) / v["d"])))


class DimensionSelector(Estimator, HasInputCol, HasOutputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps dimensions by `rule`: those of a variance over `threshold`, or the `most` of greatest chi-square by class,
    as gridlark.operators.scaling finds them."""

    rule = Param(Params._dummy(), "rule", "variance or chi2", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "least variance, itself left out", TypeConverters.toFloat)
    most = Param(Params._dummy(), "most", "dimensions that chi2 keeps", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "selected", labelCol: str = "label", rule: str = "variance", threshold: float = 0.05, most: int = 30):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="selected", labelCol="label", rule="variance", threshold=0.05, most=30)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> DimensionSelectorModel:
        if self.getOrDefault(self.rule) == "chi2":
            label = F.col(self.getLabelCol()).alias("label")
            chosen = scaling.chi2_select(_long(dataset, self.getInputCol(), label), "label", self.getOrDefault(self.most))
        else:
            chosen = scaling.variance_select(_long(dataset, self.getInputCol()), self.getOrDefault(self.threshold))
        return DimensionSelectorModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol())._set(kept=sorted(r["dim"] for r in chosen.select("dim").collect()))


class DimensionSelectorModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    kept = Param(Params._dummy(), "kept", "dimensions that stay, ascending", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "selected"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="selected")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(self.getInputCol())
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(*(F.get(x, F.lit(k)) for k in self.getOrDefault(self.kept))).cast("array<double>")))
