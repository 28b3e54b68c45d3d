"""Multi-layer perceptron with an L2 term, by full-batch quasi-Newton steps.

The loss is the mean cross entropy plus ``alpha / 2n`` times the squared weights (biases are free); hidden units are
rectified. Each evaluation is one Spark job: every partition runs back-propagation over its blocks and gives the sum of losses
and gradients, which are added up (``vectors.summed``); the step itself is a vector operation on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from casemill.operators.classifiers import _Descent
from casemill.operators.stages import (
    ClassifierParams,
    DefaultParamsReadable,
    DefaultParamsWritable,
    Estimator,
    StatefulModel,
    keyword_only,
    param,
)
from casemill.operators.vectors import block_score, packed, summed, width_of

#: Numbers of a layer that are held at a time (32 MB).
LAYER_NUMBERS = 4_000_000


def layers_of(vector: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases of each layer, as views of one vector."""
    out, at = [], 0
    for n, m in zip(sizes, sizes[1:]):
        out.append((vector[at : at + n * m].reshape(n, m), vector[at + n * m : at + n * m + m]))
        at += (n + 1) * m
    return out


def outputs(x: np.ndarray, layers) -> list[np.ndarray]:
    """The input, the rectified hidden layers and the raw output."""
    values = [x]
    for i, (weights, bias) in enumerate(layers):
        z = values[-1] @ weights + bias
        values.append(z if i == len(layers) - 1 else np.maximum(z, 0.0))
    return values


def loss_and_gradient(vector: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of the losses of a block, then the gradient."""
    layers = layers_of(vector, sizes)
    total = np.zeros(len(vector) + 1)
    into = layers_of(total[1:], sizes)
    step = max(1, LAYER_NUMBERS // max(sizes))
    for start in range(0, len(x), step):
        values, labels = outputs(x[start : start + step], layers), y[start : start + step]
        z = values[-1] - values[-1].max(axis=1, keepdims=True)
        scale = np.log(np.exp(z).sum(axis=1))
        place = np.arange(len(labels)), labels
        total[0] += (scale - z[place]).sum()
        back = np.exp(z - scale[:, None])
        back[place] -= 1.0
        for i in range(len(layers) - 1, -1, -1):
            into[i][0][...] += values[i].T @ back
            into[i][1][...] += back.sum(axis=0)
            if i:
                back = (back @ layers[i][0].T) * (values[i] > 0)
    return total


class Perceptrons(Estimator, ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Hidden layers of rectified units and a softmax output. ``classes`` 0 takes the largest label seen."""

    hidden = param("hidden", "sizes of the hidden layers")
    alpha = param("alpha", "strength of the L2 term", "float")
    passes = param("passes", "largest number of passes over the data", "int")
    classes = param("classes", "number of classes", "int")

    @keyword_only
    def __init__(
        self, hidden=None, alpha=0.0001, passes=200, classes=0, seed=0,
        featuresCol="features", labelCol="label", predictionCol="prediction",
    ):
        super().__init__()
        self._setDefault(hidden=[100], alpha=0.0001, passes=200, classes=0, seed=0, keyCol="case_id")
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> PerceptronsModel:
        label = F.col(self.getLabelCol()).cast("int")
        present = {r["y"]: r["n"] for r in df.groupBy(label.alias("y")).agg(F.count("*").alias("n")).collect()}
        if not present:
            raise ValueError("no rows to fit on")
        n, classes = sum(present.values()), self.getOrDefault("classes") or max(present) + 1
        sizes = [width_of(df, self.getFeaturesCol()), *map(int, self.getOrDefault("hidden")), classes]
        random, start = np.random.default_rng(self.getOrDefault("seed")), []
        for a, b in zip(sizes, sizes[1:]):
            bound = np.sqrt(6.0 / (a + b))
            start.append(random.uniform(-bound, bound, (a + 1) * b))
        run, alpha = _Descent(np.concatenate(start)), self.getOrDefault("alpha")
        blocks = packed(df, self.getFeaturesCol(), label).persist()
        try:
            blocks.count()
            partitions = blocks.rdd.getNumPartitions()
            for _ in range(self.getOrDefault("passes")):
                point = run.trial()
                shared = df.sparkSession.sparkContext.broadcast(point)  # the size of the model

                def back(parts, shared=shared):
                    total = None
                    for x, y in parts:
                        part = loss_and_gradient(shared.value, sizes, x, y)
                        total = part if total is None else total + part
                    return total

                sums = summed(blocks, back, len(point) + 1, partitions) / n
                shared.unpersist()
                pull = np.zeros_like(point)
                for (weights, _), (into, _) in zip(layers_of(point, sizes), layers_of(pull, sizes)):
                    into[...] = weights
                run.take(sums[0] + 0.5 * alpha / n * (pull @ pull), sums[1:] + alpha / n * pull)
                if run.done:
                    break
        finally:
            blocks.unpersist()
        absent = sorted(set(range(classes)) - set(present))
        return self._copyValues(PerceptronsModel(run.point, sizes, absent, run.done))


class PerceptronsModel(StatefulModel, ClassifierParams):
    """``converged`` tells whether the gradient became small within the passes. Absent classes are never predicted."""

    def __init__(self, vector=None, sizes=None, absent=(), converged=False):
        super().__init__()
        self._setDefault(keyCol="case_id")
        self.vector, self.sizes, self.absent, self.converged = vector, sizes, list(absent), bool(converged)

    def _state(self):
        return [self.vector.tolist(), self.sizes, self.absent, self.converged], {}

    def _restore(self, small, table) -> None:
        vector, self.sizes, self.absent, self.converged = small
        self.vector = np.array(vector)

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.vector, self.sizes, self.absent))

        def predict(block: np.ndarray) -> np.ndarray:
            vector, sizes, absent = shared.value
            layers, step = layers_of(vector, sizes), max(1, LAYER_NUMBERS // max(sizes))
            out = []
            for start in range(0, len(block), step):
                scores = outputs(block[start : start + step], layers)[-1]
                scores[:, absent] = -np.inf
                out.append(scores.argmax(axis=1))
            return np.concatenate(out)

        return df.withColumn(self.getPredictionCol(), block_score(F.col(self.getFeaturesCol()), predict))
