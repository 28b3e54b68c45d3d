"""Registered queries of the feature, reduction and classifier stages."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from casemill.operators import features as ft
from casemill.operators.evidence import ABSENT_COUNT, PRESENT_COUNT
from casemill.operators.isomap import Isomap, graph_of
from casemill.operators.neighbors import knn_join
from casemill.operators.reduce import CenteredPCA, TruncatedSVD
from casemill.operators.registry import NamedClassifier
from casemill.operators.splits import FOLD, stratified_folds
from casemill.operators.vectors import vector_entries
from casemill.plans import table_cases as tc
from casemill.schema import KEY
from casemill.session import write_through

ROUND = 6
#: Fits of many short jobs: those of different folds run at the same time.
SIDE_BY_SIDE = (
    "GradientBoostingClassifier",
    "ExtraTreesClassifier",
    "DecisionTreeClassifier",
    "RandomForestClassifier",
)
FOLDS = 5


def scaled_cases(spark: SparkSession, sf: str) -> DataFrame:
    cases = tc.with_age(tc.people(spark, sf))
    return ft.CaseScaler().fit(cases).transform(cases)


def sex_ordinal(spark, sf):
    return scaled_cases(spark, sf).select(KEY, F.col("sex_code").cast("int").alias("sex_code"))


def age_standardized(spark, sf):
    return scaled_cases(spark, sf).select(KEY, F.round("age_scaled", ROUND).alias("age_scaled"))


def _assembled(spark, sf, count: bool, absent: bool) -> DataFrame:
    nested = write_through(tc.nested_cases(spark, sf))
    stages = ft.feature_stages(count, absent, [PRESENT_COUNT, ABSENT_COUNT])
    return Pipeline(stages=stages).fit(nested).transform(nested)


def _entries(df: DataFrame) -> DataFrame:
    """Non-zero vector entries as ``case_id, place, value``."""
    return (
        vector_entries(df, KEY, "features").withColumn("value", F.round("value", ROUND)).filter("value <> 0")
    )


def evidence_count_minmax(spark, sf):
    nested = write_through(tc.nested_cases(spark, sf))
    scaler = ft.CaseScaler(countCols=[PRESENT_COUNT, ABSENT_COUNT])
    return scaler.fit(nested).transform(nested).select(
        KEY,
        *[F.round(f"{c}_scaled", ROUND).alias(f"{c}_scaled") for c in (PRESENT_COUNT, ABSENT_COUNT)],
    )


def assembled_features(spark, sf):
    return _entries(_assembled(spark, sf, count=True, absent=True))


def assembled_features_present_only(spark, sf):
    return _entries(_assembled(spark, sf, count=False, absent=False))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tc.read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias(KEY),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("label"),
    )


def _norms(df: DataFrame) -> DataFrame:
    squares = F.aggregate(vector_to_array("reduced"), F.lit(0.0), lambda a, x: a + x * x)
    return df.select(F.col(KEY).alias("vec_id"), F.round(squares, ROUND).alias("norm2"))


def pca_row_norms(spark, sf):
    """All components: a rotation, so a row keeps its squared distance from the mean."""
    rows = vectors(spark, sf)
    return _norms(CenteredPCA().fit(rows).transform(rows))


def svd_row_norms(spark, sf):
    """As many components as features: a rotation, so a row keeps its squared length."""
    rows = vectors(spark, sf)
    return _norms(TruncatedSVD(k=64).fit(rows).transform(rows))


def _reduced(df: DataFrame, column: str = "reduced") -> DataFrame:
    return df.select(F.col(KEY).alias("vec_id"), F.posexplode(vector_to_array(column)).alias("dimension", "value"))


def pca_embedding(spark, sf):
    rows = vectors(spark, sf)
    return _reduced(CenteredPCA(k=10).fit(rows).transform(rows))


def svd_embedding(spark, sf):
    rows = vectors(spark, sf)
    return _reduced(TruncatedSVD(k=10).fit(rows).transform(rows))


def neighbor_graph(spark, sf):
    """The symmetric neighbour graph that Isomap walks on."""
    points = vectors(spark, sf).select(F.col(KEY).alias("key"), vector_to_array("features").alias("vector"))
    return graph_of(points, 5).select("src", "dst", F.round("w", ROUND).alias("w"))


def neighbors_blocked(spark, sf):
    """The neighbour join in its form for tables too large to broadcast."""
    points = vectors(spark, sf).select(F.col(KEY).alias("key"), vector_to_array("features").alias("vector"))
    found = knn_join(points, points, 5, exclude_self=True, block_rows=128, broadcast_numbers=0)
    return found.select("key", "neighbor", F.round(F.sqrt("distance2"), ROUND).alias("distance"))


def isomap_embedding(spark, sf):
    rows = vectors(spark, sf)
    return _reduced(Isomap(k=10, landmarks=64).fit(rows).transform(rows))


def folded_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_folds(vectors(spark, sf), KEY, "label")


def predictions(spark, sf, name: str, params: dict | None = None) -> DataFrame:
    """Predictions for every row by the model fitted on the folds without it."""
    folded = write_through(folded_vectors(spark, sf))
    stage = NamedClassifier(name=name, params_=params or {}, seed=31415)

    def predicted(fold: int) -> DataFrame:
        model = stage.fit(folded.filter(F.col(FOLD) != fold))
        return model.transform(folded.filter(F.col(FOLD) == fold)).select(
            F.col(KEY).alias("vec_id"),
            F.col(FOLD),
            F.col("label").cast("int").alias("label"),
            F.col("prediction").cast("int").alias("prediction"),
        )

    if name not in SIDE_BY_SIDE:
        return reduce(DataFrame.unionByName, map(predicted, range(FOLDS)))
    with ThreadPool(FOLDS) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(predicted), range(FOLDS)))


CLASSIFIER_QUERIES = {
    "majority_predict": ("DummyClassifier", {}),
    "knn_predict": ("KNeighborsClassifier", {"n_neighbors": 5}),
    "decision_tree": ("DecisionTreeClassifier", {}),
    "logistic_regression": ("LogisticRegression", {}),
    "linear_svc": ("LinearSVC", {}),
    "kernel_svc": ("SVC", {}),
    "mlp": ("MLPClassifier", {}),
    "linear_discriminant": ("LinearDiscriminantAnalysis", {}),
    "random_forest": ("RandomForestClassifier", {}),
    "extra_trees": ("ExtraTreesClassifier", {}),
    "passive_aggressive": ("PassiveAggressiveClassifier", {"C": 0.1}),
    "perceptron": ("Perceptron", {"penalty": "l2", "alpha": 0.0001}),
    "gradient_boosting": ("GradientBoostingClassifier", {}),
}


def _classifier(name, params):
    return lambda spark, sf: predictions(spark, sf, name, params)


QUERIES = {
    f.__name__: f
    for f in (
        sex_ordinal,
        age_standardized,
        evidence_count_minmax,
        assembled_features,
        assembled_features_present_only,
        pca_row_norms,
        svd_row_norms,
        pca_embedding,
        svd_embedding,
        neighbor_graph,
        neighbors_blocked,
        isomap_embedding,
    )
} | {query: _classifier(*model) for query, model in CLASSIFIER_QUERIES.items()}
