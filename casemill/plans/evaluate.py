"""Cross-validated sweeps, grid search, best predictor, learning curve and their tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock, Semaphore
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from casemill.functions.scalar import to_number
from casemill.operators import ranking as rk
from casemill.operators.features import feature_stages
from casemill.operators.isomap import Isomap
from casemill.operators.reduce import CenteredPCA, TruncatedSVD
from casemill.operators.registry import MODELS, NamedClassifier, candidates, model_str
from casemill.operators.splits import FOLD, prefix_cutoffs, stratified_folds
from casemill.plans.shared import FoldSpaces, SharedDiscriminants, SharedNeighbours, is_joint, score_joint
from casemill.schema import KEY, RESULT_SCHEMA, TARGET
from casemill.sources.results import ResultStore, save_model

SEED = 31415
# What a stage raises for settings that do not fit its data.
INVALID = (ValueError, IllegalArgumentException)
STORAGE = StorageLevel.MEMORY_AND_DISK
# Searches for neighbours that run side by side: the training points of each pass through the driver.
SEARCHES = 2

REDUCERS: dict[str, Callable] = {
    "PCA": lambda n: CenteredPCA(k=n),
    "TruncatedSVD": lambda n: TruncatedSVD(k=n),
    "Isomap": lambda n: Isomap(k=n, seed=SEED),
}

BUILT_IN = dict(REDUCERS)


def register_reducer(name: str, build: Callable[[int | None], Estimator]) -> None:
    """Add a user's own reducer: ``build(n_dimensions)`` gives an estimator from ``features`` to ``reduced``."""
    REDUCERS[name] = build


# The options of the full sweep.
FULL_SWEEP = {
    "models": list(MODELS),
    "reducers": [None, "PCA", "TruncatedSVD", "Isomap"],
    "dimensions": [10, 50, 100, 250, None],
    "count_evidence": [False, True],
    "include_absent": [False, True],
}


class Layout(NamedTuple):
    """Everything before the classifier."""

    reducer: str | None = None
    n_dimensions: int | None = None
    count_evidence: bool = False
    include_absent: bool = True


class Candidate(NamedTuple):
    seq: int
    model: str
    params: dict
    layout: Layout


def accuracy(label: Column, prediction: Column) -> Column:
    return F.avg((label == prediction).cast("double"))


def is_valid(layout: Layout) -> bool:
    """Combinations rejected before any job runs.

    Without a reducer there is no number of dimensions; only PCA can do without one.
    """
    if layout.reducer is None:
        return layout.n_dimensions is None
    if layout.reducer not in REDUCERS:
        return False
    return layout.n_dimensions is not None or layout.reducer == "PCA"


def check_layout(layout: Layout) -> Layout:
    if not is_valid(layout):
        raise ValueError(f"invalid combination {layout}")
    return layout


def preprocessing(layout: Layout, count_cols: Sequence[str] = ()) -> Pipeline:
    """Encoder, scaler, assembler and the optional reducer; the result column is ``input``."""
    check_layout(layout)
    stages = feature_stages(layout.count_evidence, layout.include_absent, list(count_cols))
    if layout.reducer:
        stages.append(REDUCERS[layout.reducer](layout.n_dimensions))
    return Pipeline(stages=stages)


def input_column(layout: Layout) -> str:
    return "reduced" if layout.reducer else "features"


def full_pipeline(
    model: str, params: dict, layout: Layout, classes: int = 0, count_cols: Sequence[str] = (), seed: int = SEED
) -> Pipeline:
    stage = NamedClassifier(
        name=model, params_=params, classes=classes, seed=seed, featuresCol=input_column(layout)
    )
    return Pipeline(stages=[*preprocessing(layout, count_cols).getStages(), stage])


def fit_transform_features(df: DataFrame, layout: Layout, count_cols: Sequence[str] = ()) -> DataFrame:
    """Fit all steps but the classifier on ``df`` and apply them to it."""
    return preprocessing(layout, count_cols).fit(df).transform(df)


def index_labels(cases: DataFrame, target: str = TARGET) -> tuple[DataFrame, list[str]]:
    """Add a double ``label``; ids follow the sorted labels of all rows, so every fold agrees."""
    model = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(cases)
    return model.transform(cases), list(model.labels)


def with_folds(cases: DataFrame, folds: int = 5) -> DataFrame:
    return stratified_folds(cases, KEY, "label", folds)


def sweep_candidates(
    models: Iterable[str],
    reducers: Iterable[str | None],
    dimensions: Iterable[int | None],
    count_evidence: Iterable[bool],
    include_absent: Iterable[bool],
) -> list[Candidate]:
    """Valid combinations in nested order, model outermost, numbered from 0."""
    layouts = [
        Layout(r, n, c, a)
        for r in reducers
        for n in dimensions
        for c in count_evidence
        for a in include_absent
        if is_valid(Layout(r, n, c, a))
    ]
    pairs = [(m, layout) for m in models for layout in layouts]
    return [Candidate(i, m, {}, layout) for i, (m, layout) in enumerate(pairs)]


class Evaluator:
    """Scores candidates on cases with ``case_id``, features, ``label`` and ``fold``.

    Candidates with the same evidence options share the encoded features of a fold, those with
    the same reducer its decomposition, and most frequent, neighbours and discriminant analysis also their
    passes (see ``plans.shared``). Everything shared is computed once, persisted, and released. Up to ``threads`` folds run at a time, so that the executors stay
    busy during the many short jobs. ``features`` names a ready-made vector column, which then
    takes the place of the encoded cases in every layout; neighbours among too many of them to broadcast are then looked for
    once for all folds, and for all the ``neighbors`` (numbers that later searches ask for). Discriminant analysis of a single
    layout without a reducer is fitted and scored on all folds and prefixes by the same passes.
    """

    def __init__(
        self,
        cases: DataFrame,
        classes: int,
        folds: int = 5,
        metric: Callable[[Column, Column], Column] = accuracy,
        count_cols: Sequence[str] = (),
        threads: int = 5,
        seed: int = SEED,
        features: str | None = None,
        neighbors: Sequence[int] = (),
    ):
        self.features = features
        self.near = SharedNeighbours(self, neighbors)
        self.linear = SharedDiscriminants(self)
        self.cases, self.classes, self.folds, self.metric = cases, classes, folds, metric
        self.count_cols, self.threads, self.seed = list(count_cols), threads, seed
        self.spark: SparkSession = cases.sparkSession
        self.storage, self.reducers, self.searches = STORAGE, REDUCERS, Semaphore(SEARCHES)
        self.failures: list[tuple] = []

    def _encoded(self, layout: Layout, fold: int, rows: Column | None) -> DataFrame:
        """Encoded features of all used rows, fitted on the training rows of the fold."""
        used = self.cases if rows is None else self.cases.filter((F.col(FOLD) == fold) | rows)
        if self.features:
            return used.select(KEY, "label", FOLD, F.col(self.features).alias("features")).persist(STORAGE)
        plain = layout._replace(reducer=None, n_dimensions=None)
        fitted = preprocessing(plain, self.count_cols).fit(used.filter(F.col(FOLD) != fold))
        return fitted.transform(used).select(KEY, "label", FOLD, "features").persist(STORAGE)

    def _scores(self, predicted: DataFrame, fold: int, columns: Sequence[Column]) -> list[tuple]:
        """``(train, test)`` of each prediction column, in one pass."""
        sides = predicted.groupBy((F.col(FOLD) == fold).alias("held_out")).agg(
            *[self.metric(F.col("label"), c).alias(f"s{i}") for i, c in enumerate(columns)]
        )
        found = {r["held_out"]: r for r in sides.collect()}
        return [tuple(found[side][f"s{i}"] if side in found else None for side in (False, True)) for i in range(len(columns))]

    def _fold(self, group: Sequence[Candidate], fold: int, rows: Column | None, report, known: dict) -> None:
        """All candidates of one evidence option on one fold: first those that share passes, then layout by layout.

        What a stage rejects is noted with its reason; an error of the metric is an error of the search.
        """
        encoded = self._encoded(group[0].layout, fold, rows)
        own = {n: make for n, make in REDUCERS.items() if BUILT_IN.get(n) is not make}
        spaces = FoldSpaces(self, encoded, fold, own, INVALID)
        dimensions: dict = {}
        for c in group:
            dimensions.setdefault(c.layout.reducer, []).append(c.layout.n_dimensions)
        try:
            shared = [c for c in group if is_joint(c, own) and c.seq not in known]
            scores, reasons, rest = score_joint(spaces, shared, dimensions, lambda df, columns: self._scores(df, fold, columns))
            scores.update(known)
            single = [*rest, *(c for c in group if c not in shared and c.seq not in known)]
            for layout in dict.fromkeys(c.layout for c in group):
                for c in [c for c in single if c.layout == layout]:
                    try:
                        ready, column = spaces.rows(layout, dimensions[layout.reducer])
                        stage = NamedClassifier(
                            name=c.model, params_=c.params, classes=self.classes, seed=self.seed, featuresCol=column
                        )
                        predicted = stage.fit(ready.filter(F.col(FOLD) != fold)).transform(ready)
                    except INVALID as error:
                        reasons[c.seq] = str(error)
                        continue
                    (scores[c.seq],) = self._scores(predicted, fold, [F.col("prediction")])
                members = [c for c in group if c.layout == layout]
                report(layout, fold, {c.seq: scores.get(c.seq) for c in members}, reasons)
        finally:
            spaces.close()
            encoded.unpersist()

    def evaluate(
        self,
        wanted: Sequence[Candidate],
        rows: Callable[[int], Column] | None = None,
        done: Callable[[DataFrame], None] | None = None,
        upto: dict | None = None,
    ) -> DataFrame:
        """One result row per candidate. A candidate that a stage rejects gives no row.

        ``rows(fold)`` may restrict the training rows, ``upto[fold]`` gives their last key; ``done`` receives the finished
        rows of each layout, for checkpoints.
        """
        if upto is not None:
            rows = lambda f: F.col(KEY) <= upto[f]
        # Neighbours that all folds share; rows chosen otherwise are left to the fold.
        near = [c for c in wanted if self.near.takes(c)] if rows is None or upto is not None else []
        sets = [(f, upto[f] if upto else None) for f in range(self.folds)]
        if near:
            self.near.prepare(sets, [int(c.params.get("n_neighbors", 5)) for c in near])
        alone = len(wanted) == 1 and self.linear.takes(wanted[0]) and (rows is None or upto is not None)
        alone = alone and (upto is None or None not in upto.values()) and self.linear.prepare(sets, wanted[0])

        found: list[tuple] = []
        failed: dict[int, tuple] = {}
        scores: dict[int, dict[int, tuple]] = {c.seq: {} for c in wanted}
        finished: dict[Layout, int] = {}
        lock = Lock()

        def report(layout: Layout, fold: int, seen: dict, reasons: dict) -> None:
            with lock:
                for seq, score in seen.items():
                    if score is not None:
                        scores[seq][fold] = score
                    else:
                        if seq not in failed or fold < failed[seq][0]:
                            failed[seq] = (fold, reasons[seq])
                finished[layout] = finished.get(layout, 0) + 1
                if finished[layout] < self.folds:
                    return
                new = [
                    self._row(c, [(f, *scores[c.seq][f]) for f in range(self.folds)])
                    for c in wanted
                    if c.layout == layout and len(scores[c.seq]) == self.folds
                ]
                found.extend(new)
                if done and new:
                    done(self.spark.createDataFrame(new, RESULT_SCHEMA))

        for f, cut in sets if alone else []:
            score = self.linear.score(wanted[0], f, cut)
            failure = isinstance(score, ValueError)
            report(wanted[0].layout, f, {wanted[0].seq: None if failure else score}, {wanted[0].seq: str(score)})

        options = dict.fromkeys((c.layout.count_evidence, c.layout.include_absent) for c in wanted)
        units = [
            ([c for c in wanted if (c.layout.count_evidence, c.layout.include_absent) == o], fold)
            for o in options
            for fold in range(self.folds)
            if not alone
        ]
        with ThreadPoolExecutor(self.threads) as pool:
            known = [self.near.scores(*sets[f], [c for c in g if c in near]) for g, f in units]
            work = [pool.submit(self._fold, g, f, rows(f) if rows else None, report, k) for (g, f), k in zip(units, known)]
            for unit in work:
                unit.result()
        self.failures = [
            (c.seq, c.model, model_str(c.model), *c.layout, {k: json.dumps(v) for k, v in c.params.items()}, *failed[c.seq])
            for c in wanted
            if c.seq in failed
        ]
        return self.spark.createDataFrame(sorted(found, key=lambda r: r[0]), RESULT_SCHEMA)

    def failed(self) -> DataFrame:
        """The candidates of the last search that a stage rejected: the first such fold, and the reason."""
        fields = [f for f in RESULT_SCHEMA.fields if f.name not in ("mean_train_score", "mean_test_score", "fold_scores")]
        more = [T.StructField("fold", T.IntegerType()), T.StructField("reason", T.StringType())]
        return self.spark.createDataFrame(self.failures, T.StructType([*fields, *more]))

    @staticmethod
    def _row(c: Candidate, scores: list[tuple]) -> tuple:
        def mean(values):
            return sum(values) / len(values) if values and None not in values else None

        params = {k: json.dumps(v) for k, v in c.params.items()}
        layout = c.layout
        return (
            c.seq, c.model, model_str(c.model), layout.reducer, layout.n_dimensions,
            layout.count_evidence, layout.include_absent, params,
            mean([s[1] for s in scores]), mean([s[2] for s in scores]), scores,
        )

    # --- the two searches ------------------------------------------------------------------

    def sweep(self, wanted: Sequence[Candidate], store: ResultStore | None = None) -> DataFrame:
        """All candidates; with a store, finished ones are read back instead of fitted again."""
        return self._stored("train_and_evaluate", wanted, store)

    def grid_search(
        self, best: DataFrame, grids: dict[str, dict[str, list]] | None = None, store: ResultStore | None = None
    ) -> DataFrame:
        """Every parameter combination on the best layout of its class.

        A class without a row in ``best`` is skipped.
        """
        grids = {n: s.grid for n, s in MODELS.items() if s.grid} if grids is None else grids
        rows = {r["model_class"]: r for r in best.collect()}
        wanted: list[Candidate] = []
        for name, grid in grids.items():
            if name in rows:
                layout = layout_of(rows[name])
                for params in candidates(grid):
                    wanted.append(Candidate(len(wanted), name, params, layout))
        return self._stored("grid_search", wanted, store)

    def _stored(self, table: str, wanted: Sequence[Candidate], store: ResultStore | None) -> DataFrame:
        """The rows of exactly the wanted candidates; those that the store has are not fitted again.

        A stored row belongs to a candidate by its configuration, not by its number, so other
        lists of options under the same run are neither skipped nor mixed up.
        """
        if store is None:
            return self.evaluate(wanted)
        known = {configuration(r["model_class"], params_of(r), layout_of(r)) for r in store.read(table).collect()}
        missing = [c for c in wanted if configuration(c.model, c.params, c.layout) not in known]
        self.evaluate(missing, done=lambda rows: store.append(table, rows))
        numbers = {configuration(c.model, c.params, c.layout): c.seq for c in wanted}
        found = {}  # a row per configuration
        for r in store.read(table).collect():
            seq = numbers.get(configuration(r["model_class"], params_of(r), layout_of(r)))
            if seq is not None:
                found[seq] = (seq, *tuple(r)[1:])
        return self.spark.createDataFrame([found[s] for s in sorted(found)], RESULT_SCHEMA)

    def best_predictor(self, best: DataFrame, path: str | None = None) -> PipelineModel:
        """The pipeline with the highest test score, with its tuned parameters, fitted on all rows."""
        row = rk.best_per_group(best, None, "mean_test_score").first()
        if row is None:
            raise ValueError("no evaluated candidate")
        layout = layout_of(row)
        pipeline = full_pipeline(row["model_class"], params_of(row), layout, self.classes, self.count_cols, self.seed)
        cases = self.cases
        if self.features:
            cases = cases.withColumn("features", F.col(self.features))
            reducer = [REDUCERS[layout.reducer](layout.n_dimensions)] if layout.reducer else []
            pipeline = Pipeline(stages=[*reducer, pipeline.getStages()[-1]])
        model = pipeline.fit(cases)
        if path is not None:
            save_model(model, path)
        return model

    def learning_curve(
        self, row, fractions: Sequence[float] = (0.85, 0.9, 0.95, 1.0)
    ) -> DataFrame:
        """``fraction, n_rows, fold, train_score, test_score`` of the candidate in ``row``."""
        cuts = prefix_cutoffs(self.cases.select(KEY, FOLD), KEY, fractions, self.folds).collect()
        out = []
        candidate = Candidate(0, row["model_class"], params_of(row), layout_of(row))
        if cuts and self.near.takes(candidate):  # one search for all prefixes
            sets = [(r["fold"], r["cutoff_key"]) for r in cuts]
            self.near.prepare(list(dict.fromkeys(sets)), [int(candidate.params.get("n_neighbors", 5))])
        ends = [(r["fold"], r["cutoff_key"]) for r in cuts if r["cutoff_key"] is not None]
        if ends and self.linear.takes(candidate):  # the same passes for all prefixes
            self.linear.prepare(ends, candidate)
        for fraction in fractions:
            ends = {r["fold"]: r for r in cuts if r["fraction"] == fraction}
            if not ends:
                continue
            scored = self.evaluate([candidate], upto={f: r["cutoff_key"] for f, r in ends.items()}).first()
            if scored is None:
                raise ValueError(f"the candidate cannot be fitted on {fraction} of the rows")
            for s in scored["fold_scores"]:
                out.append((float(fraction), ends[s["fold"]]["n_rows"], s["fold"], s["train"], s["test"]))
        return self.spark.createDataFrame(
            out, "fraction double, n_rows long, fold int, train_score double, test_score double"
        )


def configuration(model: str, params: dict, layout: Layout) -> str:
    """A text that names a model with its parameters and layout."""
    return json.dumps([model, params, list(layout)], sort_keys=True)


def layout_of(row) -> Layout:
    return Layout(
        row["dim_reduction_algorithm"], row["n_dimensions"], row["count_evidence"], row["include_absent_evidence"]
    )


def params_of(row) -> dict:
    return {k: json.loads(v) for k, v in (row["params"] or {}).items()}


def best_of_sweep(results: DataFrame) -> DataFrame:
    """The best row per model, best model first."""
    best = rk.best_per_group(results, "model_str", "mean_test_score").select(*results.columns)
    return rk.by_score(best, "mean_test_score")


def best_parameters(sweep: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Best sweep row per model, overlaid with the scores and parameters of its best grid row."""
    best = rk.best_per_group(sweep, "model_str", "mean_test_score").select(*sweep.columns)
    if grid is not None:
        tuned = rk.best_per_group(grid, "model_str", "mean_test_score")
        columns = ["mean_train_score", "mean_test_score", "params", "fold_scores"]
        best = rk.overlay(best, tuned, "model_str", columns).select(*sweep.columns)
    return rk.by_score(best, "mean_test_score")


def score_by_parameter(results: DataFrame, model_class: str, parameter: str) -> DataFrame:
    """Mean and deviation of both scores per value of a parameter or of a result column.

    ``numeric_value`` is null for values that are no number.
    """
    rows = results.filter(F.col("model_class") == model_class)
    value = F.col(parameter) if parameter in results.columns else F.col("params")[parameter]
    scored = rows.select(value.cast("string").alias("value"), "mean_train_score", "mean_test_score")
    stats = rk.mean_and_std(scored, "value", ["mean_train_score", "mean_test_score"])
    return stats.withColumn("numeric_value", to_number(F.col("value")))


def has_series(series: DataFrame) -> bool:
    """Whether a parameter took more than one numeric value."""
    return series.agg(F.countDistinct("numeric_value").alias("n")).first()["n"] > 1
