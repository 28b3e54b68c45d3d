"""Classifiers by name: how each is built and which parameters are tuned."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from typing import NamedTuple

from pyspark.ml import Estimator
from pyspark.ml import classification as mlc
from pyspark.sql import DataFrame, functions as F

from casemill.operators.boosting import GradientBoosting
from casemill.operators.classifiers import (
    KernelSVC,
    LinearDiscriminant,
    LinearMargin,
    MostFrequent,
    OnlineLinear,
)
from casemill.operators.extra_trees import ExtraTrees
from casemill.operators.neighbors import KNeighbors
from casemill.operators.network import Perceptrons
from casemill.operators.stages import (
    ClassifierParams,
    DefaultParamsReadable,
    DefaultParamsWritable,
    keyword_only,
    param,
)
from casemill.operators.vectors import width_of

# The deepest tree that Spark builds; it is the default, as there is no unlimited depth.
MAX_DEPTH = 30


class Size(NamedTuple):
    rows: int
    features: int
    classes: int
    seed: int


class ModelSpec(NamedTuple):
    build: Callable[[Size, dict, dict], Estimator]
    grid: dict[str, list]


def depth(value: int) -> int:
    """A depth that can be built as it is; any other is an invalid parameter."""
    if value is None or not 0 <= int(value) <= MAX_DEPTH:
        raise ValueError(f"max_depth must be between 0 and {MAX_DEPTH}, not {value}")
    return int(value)


def _logistic(size: Size, p: dict, c: dict):
    return mlc.LogisticRegression(
        family="multinomial", standardization=False, elasticNetParam=0.0, maxIter=100,
        regParam=1.0 / (p.get("C", 1.0) * size.rows), **c,
    )


def _tree(size: Size, p: dict, c: dict):
    return mlc.DecisionTreeClassifier(
        impurity="gini", maxDepth=depth(p.get("max_depth", MAX_DEPTH)), seed=size.seed, **c
    )


def _forest(size: Size, p: dict, c: dict):
    return mlc.RandomForestClassifier(
        numTrees=p.get("n_estimators", 100),
        maxDepth=depth(p.get("max_depth", MAX_DEPTH)),
        featureSubsetStrategy="sqrt",
        seed=size.seed,
        **c,
    )


def _extra_trees(size: Size, p: dict, c: dict):
    return ExtraTrees(trees=p.get("n_estimators", 100), depth=p.get("max_depth"), seed=size.seed, **c)


def _boosting(size: Size, p: dict, c: dict):
    return GradientBoosting(rounds=p.get("n_estimators", 100), depth=p.get("max_depth", 3), seed=size.seed, **c)


def _mlp(size: Size, p: dict, c: dict):
    return Perceptrons(
        hidden=list(p.get("hidden_layer_sizes", (100,))), alpha=p.get("alpha", 0.0001), classes=size.classes, seed=size.seed, **c
    )


def _online(kind: str):
    def build(size: Size, p: dict, c: dict):
        return OnlineLinear(kind=kind, seed=size.seed, **p, **c)

    return build


# The tuned parameters and their candidates.
_STRENGTH = [0.001, 0.01, 0.1, 1.0, 10.0]
_DEPTHS = [1, 10, MAX_DEPTH]  # 50, 200, 500 and no limit cannot be built by Spark's own trees
_ANY_DEPTH = [1, 10, 50, 200, 500, None]
_TREES = [10, 100, 500, 1000]

MODELS: dict[str, ModelSpec] = {
    "DummyClassifier": ModelSpec(lambda s, p, c: MostFrequent(**c), {}),
    "KNeighborsClassifier": ModelSpec(
        lambda s, p, c: KNeighbors(k=p.get("n_neighbors", 5), **c),
        {"n_neighbors": [2, 5, 10, 20, 50]},
    ),
    "DecisionTreeClassifier": ModelSpec(_tree, {"max_depth": _DEPTHS}),
    "LogisticRegression": ModelSpec(_logistic, {"C": _STRENGTH}),
    "LinearSVC": ModelSpec(lambda s, p, c: LinearMargin(C=p.get("C", 1.0), **c), {"C": _STRENGTH}),
    "SVC": ModelSpec(lambda s, p, c: KernelSVC(C=p.get("C", 1.0), seed=s.seed, **c), {"C": _STRENGTH}),
    "MLPClassifier": ModelSpec(
        _mlp, {"alpha": [0.00001, 0.0001, 0.001, 0.01, 0.1], "hidden_layer_sizes": [(5,), (50,), (200,), (500,)]}
    ),
    "LinearDiscriminantAnalysis": ModelSpec(
        lambda s, p, c: LinearDiscriminant(shrinkage=p.get("shrinkage"), **c),
        {"shrinkage": [None, 0.0, 0.3, 0.6, 1.0]},
    ),
    "RandomForestClassifier": ModelSpec(_forest, {"max_depth": _DEPTHS, "n_estimators": _TREES}),
    "ExtraTreesClassifier": ModelSpec(_extra_trees, {"max_depth": _ANY_DEPTH, "n_estimators": _TREES}),
    "PassiveAggressiveClassifier": ModelSpec(_online("passive_aggressive"), {"C": _STRENGTH}),
    "Perceptron": ModelSpec(
        _online("perceptron"), {"penalty": ["l2"], "alpha": [0.00001, 0.0001, 0.001, 0.01]}
    ),
    "GradientBoostingClassifier": ModelSpec(_boosting, {"max_depth": _ANY_DEPTH, "n_estimators": _TREES}),
}


def register(name: str, spec: ModelSpec) -> None:
    """Add a user's own classifier: any estimator with features, label and prediction columns."""
    MODELS[name] = spec


def model_str(name: str, params: dict | None = None) -> str:
    return f"{name}({', '.join(f'{k}={v!r}' for k, v in (params or {}).items())})"


def candidates(grid: dict[str, list]) -> list[dict]:
    """All combinations of the values of a grid."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


class NamedClassifier(Estimator, ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """A registered classifier as a stage.

    Some stages need the shape of their input (layers, regularisation per row), known only
    when fitting: this stage measures it and then fits the real one.
    """

    name = param("name", "registered name", "str")
    params_ = param("params_", "parameters of the classifier")
    classes = param("classes", "number of classes over all data; 0 takes the largest label seen", "int")

    @keyword_only
    def __init__(
        self, name="DummyClassifier", params_=None, classes=0, seed=0,
        featuresCol="features", labelCol="label", predictionCol="prediction", keyCol="case_id",
    ):
        super().__init__()
        self._setDefault(params_={}, classes=0, seed=0, keyCol="case_id")
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame):
        features, label = self.getFeaturesCol(), self.getLabelCol()
        size = df.agg(F.count("*").alias("n"), F.max(label).alias("top")).first()
        if not size["n"]:
            raise ValueError("no rows to fit on")
        classes = self.getOrDefault("classes") or int(size["top"]) + 1
        shape = Size(size["n"], width_of(df, features), classes, self.getOrDefault("seed"))
        columns = {"featuresCol": features, "labelCol": label, "predictionCol": self.getPredictionCol()}
        if self.getOrDefault("name") in ("KNeighborsClassifier", "Perceptron", "PassiveAggressiveClassifier"):
            columns["keyCol"] = self.getOrDefault("keyCol")
        spec = MODELS[self.getOrDefault("name")]
        return spec.build(shape, dict(self.getOrDefault("params_")), columns).fit(df)
