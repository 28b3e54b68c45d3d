"""Linear dimensionality reduction: centred principal components and truncated SVD."""

from __future__ import annotations

import numpy as np
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from casemill.operators.stages import (
    DefaultParamsReadable,
    DefaultParamsWritable,
    Estimator,
    StatefulModel,
    keyword_only,
    param,
)
from casemill.operators.joint import moments, principal, singular
from casemill.operators.vectors import WIDTH_LIMIT, block_map, width_of

class _ReducerParams(HasInputCol, HasOutputCol):
    k = param("k", "number of output dimensions; None keeps as many as possible")

    def _defaults(self) -> None:
        self._setDefault(inputCol="features", outputCol="reduced", k=None)


class CenteredPCA(Estimator, _ReducerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Principal components of the covariance, from the Gram matrix of one pass."""

    @keyword_only
    def __init__(self, k=None, inputCol="features", outputCol="reduced"):
        super().__init__()
        self._defaults()
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ProjectionModel:
        column = self.getInputCol()
        components, offset = principal(moments(df, column, F.lit(0), 1), self.getOrDefault("k"))
        return self._copyValues(ProjectionModel(components, offset))


class TruncatedSVD(Estimator, _ReducerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Leading right singular vectors, without centring: from the Gram matrix, or by Spark's distributed products if a d x d
    matrix is too large for the driver."""

    @keyword_only
    def __init__(self, k=2, inputCol="features", outputCol="reduced"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ProjectionModel:
        column, k = self.getInputCol(), self.getOrDefault("k")
        d = width_of(df, column)
        if k is None or k > d:
            raise ValueError(f"{k} components from {d} features")
        if d <= WIDTH_LIMIT:
            return self._copyValues(ProjectionModel(*singular(moments(df, column, F.lit(0), 1), k)))
        rows = MLUtils.convertVectorColumnsFromML(df.select(column), column)
        right = RowMatrix(rows).computeSVD(k, computeU=False).V.toArray()
        # A rank below k leaves the last dimensions at zero.
        components = np.zeros((d, k))
        components[:, : right.shape[1]] = right
        return self._copyValues(ProjectionModel(components, np.zeros(k)))


class ProjectionModel(StatefulModel, _ReducerParams):
    """``x @ components + offset``."""

    def __init__(self, components: np.ndarray | None = None, offset: np.ndarray | None = None):
        super().__init__()
        self._defaults()
        self.components, self.offset = components, offset

    def _state(self):
        return {"components": self.components.tolist(), "offset": self.offset.tolist()}, {}

    def _restore(self, small, table) -> None:
        self.components = np.array(small["components"])
        self.offset = np.array(small["offset"])

    def _transform(self, df: DataFrame) -> DataFrame:
        # d x k doubles, bounded by WIDTH_LIMIT and the number of dimensions asked for.
        shared = df.sparkSession.sparkContext.broadcast((self.components, self.offset))

        def project(block: np.ndarray) -> np.ndarray:
            components, offset = shared.value
            return block @ components + offset

        out = self.getOutputCol()
        return df.select("*", block_map(F.col(self.getInputCol()), project, out, len(self.offset)))
