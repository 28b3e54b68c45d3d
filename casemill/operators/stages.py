"""Common ground of the custom estimators: saving and loading fitted state."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import SparkSession

__all__ = [
    "ClassifierParams",
    "DefaultParamsReadable",
    "DefaultParamsWritable",
    "Estimator",
    "StatefulModel",
    "keyword_only",
    "param",
]

_CONVERTERS = {
    "str": TypeConverters.toString,
    "int": TypeConverters.toInt,
    "float": TypeConverters.toFloat,
    "bool": TypeConverters.toBoolean,
}


def param(name: str, doc: str, kind: str | None = None) -> Param:
    return Param(Params._dummy(), name, doc, _CONVERTERS.get(kind, TypeConverters.identity))


class ClassifierParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    """Columns of a classifier: vector features, double label, double prediction."""

    keyCol = param("keyCol", "unique row key, used for ties and for repeatable order", "str")

    def _columns_from(self, other: Params) -> None:
        other._copyValues(self)


class _StateWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        small, tables = self.instance._state()
        text = spark.createDataFrame([(json.dumps(small),)], "state string")
        text.coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")


class _StateReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        small = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        instance._restore(small, lambda name: spark.read.parquet(f"{path}/{name}"))
        return instance


class StatefulModel(Model, MLWritable, MLReadable):
    """A fitted stage with a bounded JSON state and, where needed, tables.

    Subclasses give ``_state() -> (json value, {name: DataFrame})`` and ``_restore``.
    """

    def write(self):
        return _StateWriter(self)

    @classmethod
    def read(cls):
        return _StateReader(cls)
