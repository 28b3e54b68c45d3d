"""Classifiers without a built-in Spark stage, each fitted by Spark jobs."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from casemill.operators.joint import discriminant_of, moments
from casemill.operators.stages import (
    ClassifierParams,
    DefaultParamsReadable,
    DefaultParamsWritable,
    Estimator,
    StatefulModel,
    keyword_only,
    param,
)
from casemill.operators.vectors import block_map, block_score, packed, summed, width_of


class MostFrequent(Estimator, ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Always predicts the most frequent label, the smallest one on ties."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MostFrequentModel:
        label = F.col(self.getLabelCol())
        row = (
            df.groupBy(label.alias("label"))
            .agg(F.count("*").alias("n"))
            .agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
            .first()
        )
        if row["label"] is None:
            raise ValueError("no rows to fit on")
        return self._copyValues(MostFrequentModel(float(row["label"])))


class MostFrequentModel(StatefulModel, ClassifierParams):
    def __init__(self, label: float | None = None):
        super().__init__()
        self.label = label

    def _state(self):
        return self.label, {}

    def _restore(self, small, table) -> None:
        self.label = small

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getPredictionCol(), F.lit(self.label))


class LinearScoreModel(StatefulModel, ClassifierParams):
    """Predicts the class with the highest ``x @ weights.T + bias``."""

    def __init__(self, weights: np.ndarray | None = None, bias: np.ndarray | None = None):
        super().__init__()
        self._setDefault(keyCol="case_id")
        self.weights, self.bias = weights, bias

    def _state(self):
        # A class without training rows has a bias of minus infinity, which JSON lacks.
        finite = [float(b) if np.isfinite(b) else None for b in self.bias]
        return {"weights": self.weights.tolist(), "bias": finite}, {}

    def _restore(self, small, table) -> None:
        self.weights = np.array(small["weights"])
        self.bias = np.array([-np.inf if b is None else b for b in small["bias"]])

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.bias))

        def predict(block: np.ndarray) -> np.ndarray:
            weights, bias = shared.value
            return (block @ weights.T + bias).argmax(axis=1)

        return df.withColumn(
            self.getPredictionCol(), block_score(F.col(self.getFeaturesCol()), predict)
        )


class LinearDiscriminant(Estimator, ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Discriminant analysis by least squares on the (shrunk) within-class covariance.

    One pass gives the class sums and the Gram matrix; only the d x d solve runs on the driver.
    """

    shrinkage = param("shrinkage", "weight of the scaled identity in [0, 1]; None is 0")

    @keyword_only
    def __init__(self, shrinkage=None, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(shrinkage=None, keyCol="case_id")
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> LinearScoreModel:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        top = df.agg(F.max(label).alias("top")).first()["top"]
        found = moments(df, features, F.col(label), int(top or 0) + 1)
        weights, bias = discriminant_of(found, None, self.getOrDefault("shrinkage"))
        return self._copyValues(LinearScoreModel(weights, bias))


class FourierFeatures(StatefulModel, HasInputCol, HasOutputCol):
    """Random cosine features whose inner products approximate the Gaussian kernel.

    The random matrix is derived from the seed in every task, so nothing is shipped.
    """

    def __init__(self, gamma: float = 1.0, width: int = 0, size: int = 512, seed: int = 0):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="fourier")
        self.settings = [gamma, width, size, seed]

    def _state(self):
        return self.settings, {}

    def _restore(self, small, table) -> None:
        self.settings = small

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, width, size, seed = self.settings

        def expand(block: np.ndarray) -> np.ndarray:
            random = np.random.default_rng(seed)
            directions = random.normal(scale=np.sqrt(2 * gamma), size=(width, size))
            phases = random.uniform(0, 2 * np.pi, size)
            return np.sqrt(2.0 / size) * np.cos(block @ directions + phases)

        return df.select("*", block_map(F.col(self.getInputCol()), expand, self.getOutputCol(), size))


class _Descent:
    """Limited-memory quasi-Newton steps of one class, fed with one evaluation at a time."""

    def __init__(self, point: np.ndarray, memory: int = 10, tolerance: float = 1e-4):
        self.point, self.memory, self.tolerance = point, memory, tolerance
        self.value, self.gradient, self.pairs = None, None, []
        self.direction, self.step, self.done = None, 1.0, False

    def trial(self) -> np.ndarray:
        return self.point if self.direction is None else self.point + self.step * self.direction

    def take(self, value: float, gradient: np.ndarray) -> None:
        """Use the value and gradient at the trial point."""
        if self.done:
            return
        if self.direction is None:
            self.first = np.abs(gradient).max()
        else:
            slope = self.gradient @ self.direction
            if value > self.value + 1e-4 * self.step * slope:
                self.step *= 0.5
                self.done = self.step < 1e-10
                return
            moved, turned = self.step * self.direction, gradient - self.gradient
            if moved @ turned > 1e-12:
                self.pairs = [*self.pairs[1 - self.memory :], (moved, turned)]
            self.point = self.point + moved
        self.value, self.gradient = value, gradient
        self.done = np.abs(gradient).max() <= self.tolerance * max(self.first, 1e-12)
        self._aim()

    def _aim(self) -> None:
        aim, factors = self.gradient.copy(), []
        for moved, turned in reversed(self.pairs):
            factor = (moved @ aim) / (moved @ turned)
            factors.append(factor)
            aim -= factor * turned
        if self.pairs:
            moved, turned = self.pairs[-1]
            aim *= (moved @ turned) / (turned @ turned)
        else:
            aim /= max(np.linalg.norm(aim), 1.0)
        for (moved, turned), factor in zip(self.pairs, reversed(factors)):
            aim += (factor - (turned @ aim) / (moved @ turned)) * moved
        self.direction, self.step = -aim, 1.0


class LinearMargin(Estimator, ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """One-versus-rest linear support vector machines with squared hinge loss.

    Every class minimises half the squared length of its weights (bias included) plus ``C``
    times its losses. All classes share each pass over the data: one Spark job evaluates the
    loss and gradient of every class at its own trial point.
    """

    C = param("C", "inverse regularisation strength", "float")
    passes = param("passes", "largest number of passes over the data", "int")

    @keyword_only
    def __init__(self, C=1.0, passes=200, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(C=1.0, passes=200)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LinearScoreModel:
        spark, label = df.sparkSession, F.col(self.getLabelCol()).cast("int")
        d = width_of(df, self.getFeaturesCol())
        blocks = packed(df, self.getFeaturesCol(), label).persist()
        try:
            present = sorted(
                r[0] for r in blocks.select(F.explode(F.array_distinct("y"))).distinct().collect()
            )
            if not present:
                raise ValueError("no rows to fit on")
            classes, C = np.array(present), self.getOrDefault("C")
            partitions = blocks.rdd.getNumPartitions()
            runs = [_Descent(np.zeros(d + 1)) for _ in present]
            for _ in range(self.getOrDefault("passes")):
                # Classes x features doubles: the size of the model itself.
                trial = spark.sparkContext.broadcast(np.vstack([r.trial() for r in runs]))

                def losses(parts, trial=trial):
                    weights, total = trial.value, None
                    for x, y in parts:
                        sign = np.where(y[:, None] == classes, 1.0, -1.0)
                        short = np.maximum(0.0, 1.0 - sign * (x @ weights[:, :-1].T + weights[:, -1]))
                        pull = -2.0 * sign * short
                        part = np.column_stack([(short**2).sum(0), pull.T @ x, pull.sum(0)])
                        total = part if total is None else total + part
                    return None if total is None else total.ravel()

                sums = summed(blocks, losses, len(classes) * (d + 2), partitions).reshape(len(classes), d + 2)
                for run, weights, row in zip(runs, trial.value, sums):
                    run.take(0.5 * weights @ weights + C * row[0], weights + C * row[1:])
                trial.unpersist()
                if all(r.done for r in runs):
                    break
        finally:
            blocks.unpersist()
        weights, bias = np.zeros((classes.max() + 1, d)), np.full(classes.max() + 1, -np.inf)
        for c, run in zip(classes, runs):
            weights[c], bias[c] = run.point[:-1], run.point[-1]
        return self._copyValues(LinearScoreModel(weights, bias))


class KernelSVC(Estimator, ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Gaussian-kernel support vector machine through random Fourier features."""

    C = param("C", "inverse regularisation strength", "float")
    size = param("size", "number of random features", "int")

    @keyword_only
    def __init__(self, C=1.0, size=512, seed=0, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(C=1.0, size=512, seed=0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        features = self.getFeaturesCol()
        d = width_of(df, features)
        s = df.select(
            Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")
        ).first()["s"]
        n = s["count"]
        means, variances = s["mean"].toArray(), s["variance"].toArray() * (n - 1) / max(n, 1)
        # Variance over all entries of the matrix.
        spread = (variances + means**2).mean() - means.mean() ** 2
        gamma = 1.0 / (d * spread) if spread > 0 else 1.0
        expand = FourierFeatures(gamma, d, self.getOrDefault("size"), self.getOrDefault("seed"))
        expand._set(inputCol=features, outputCol=f"{features}_fourier")
        machine = LinearMargin(
            C=self.getOrDefault("C"),
            featuresCol=f"{features}_fourier",
            labelCol=self.getLabelCol(),
            predictionCol=self.getPredictionCol(),
        )
        return PipelineModel([expand, machine.fit(expand.transform(df))])


def online_step(kind: str, C: float, decay: float):
    """One pass over rows in order, updating all one-versus-rest weights in place."""

    def run(weights: np.ndarray, block: np.ndarray, labels: np.ndarray) -> int:
        mistakes = 0
        norms = np.einsum("ij,ij->i", block, block)
        for x, y, norm in zip(block, labels, norms):
            target = np.full(len(weights), -1.0)
            target[y] = 1.0
            margin = target * (weights[:, :-1] @ x + weights[:, -1])
            if kind == "perceptron":
                rate = (margin <= 0).astype(float)
                if decay:
                    weights[:, :-1] *= 1.0 - decay
            else:
                loss = np.maximum(0.0, 1.0 - margin)
                rate = np.minimum(C, loss / norm) if norm > 0 else np.zeros(len(weights))
            mistakes += int((margin <= 0).any())
            change = rate * target
            weights[:, :-1] += change[:, None] * x
            weights[:, -1] += change
        return mistakes

    return run


class OnlineLinear(Estimator, ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Perceptron or passive-aggressive learning by iterative parameter mixing.

    In every epoch each partition starts from the shared weights and learns from its own
    rows in sequence; the weights of all partitions are then averaged by row count, as
    an aggregate over (position, value) rows that combines within the tasks.
    """

    kind = param("kind", "'perceptron' or 'passive_aggressive'", "str")
    C = param("C", "largest passive-aggressive step", "float")
    alpha = param("alpha", "L2 decay per step of the perceptron", "float")
    penalty = param("penalty", "'l2' or None", None)
    epochs = param("epochs", "passes over the data", "int")
    workers = param("workers", "partitions that learn in sequence by themselves, whatever the number of rows", "int")

    @keyword_only
    def __init__(
        self,
        kind="perceptron",
        C=1.0,
        alpha=0.0001,
        penalty=None,
        epochs=10,
        workers=4,
        seed=0,
        featuresCol="features",
        labelCol="label",
        predictionCol="prediction",
        keyCol="case_id",
    ):
        super().__init__()
        self._setDefault(
            kind="perceptron", C=1.0, alpha=0.0001, penalty=None, epochs=10, workers=4, seed=0, keyCol="case_id"
        )
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> LinearScoreModel:
        spark = df.sparkSession
        key, label = self.getOrDefault("keyCol"), F.col(self.getLabelCol()).cast("int")
        d = width_of(df, self.getFeaturesCol())
        # One row per class.
        sizes = {r["y"]: r["n"] for r in df.groupBy(label.alias("y")).agg(F.count("*").alias("n")).collect()}
        if not sizes:
            raise ValueError("no rows to fit on")
        parts = self.getOrDefault("workers")
        seed = self.getOrDefault("seed")
        order = F.xxhash64(F.lit(seed), key)
        blocks = packed(df.repartition(parts, order), self.getFeaturesCol(), label, order).persist()
        decay = self.getOrDefault("alpha") if self.getOrDefault("penalty") == "l2" else 0.0
        step = online_step(self.getOrDefault("kind"), self.getOrDefault("C"), decay)
        weights = np.zeros((max(sizes) + 1, d + 1))
        try:
            for epoch in range(self.getOrDefault("epochs")):
                # Classes x features doubles: the size of the model itself.
                start = spark.sparkContext.broadcast(weights)

                def learn(parts, epoch=epoch, start=start):
                    own, seen, wrong = start.value.copy(), 0, 0
                    for i, (x, y) in enumerate(parts):
                        turn = np.random.default_rng([seed, epoch, i]).permutation(len(y))
                        wrong += step(own, x[turn], y[turn])
                        seen += len(y)
                    return np.append(own.ravel() * seen, [wrong, seen]) if seen else None

                sums = summed(blocks, learn, weights.size + 2, parts)
                start.unpersist()
                mixed = sums[:-1] / sums[-1]
                weights, errors = mixed[:-1].reshape(weights.shape), mixed[-1]
                if errors == 0.0 and self.getOrDefault("kind") == "perceptron":
                    break
        finally:
            blocks.unpersist()
        # A class without training rows is never predicted.
        absent = [c for c in range(len(weights)) if c not in sizes]
        weights[absent, -1] = -np.inf
        return self._copyValues(LinearScoreModel(weights[:, :-1], weights[:, -1]))
