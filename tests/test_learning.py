"""Neighbours, reducers, classifiers, sweeps and stored results against plain numpy."""

import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from casemill.operators import boosting, extra_trees, isomap as im, neighbors as nb
from casemill.operators.classifiers import LinearDiscriminant, LinearMargin, MostFrequent, OnlineLinear
from casemill.operators.reduce import CenteredPCA, TruncatedSVD
from casemill.operators.registry import MODELS, NamedClassifier, candidates, depth
from casemill.plans import evaluate as ev, learning
from casemill.schema import KEY
from casemill.sources.results import ResultStore, load_model


def frame(spark, x, y=None):
    y = np.zeros(len(x)) if y is None else y
    rows = [(i, [float(v) for v in row], float(c)) for i, (row, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "case_id long, vector array<double>, label double")
    return df.withColumn("features", array_to_vector("vector")).repartition(4)


def column(df, name):
    rows = df.select(KEY, vector_to_array(name).alias("v")).orderBy(KEY).collect()
    return np.array([r["v"] for r in rows])


def blobs(n=120, classes=3, d=6, seed=0, spread=0.4):
    random = np.random.default_rng(seed)
    y = np.arange(n) % classes
    return random.normal(size=(classes, d))[y] * 2 + random.normal(size=(n, d)) * spread, y


def brute(queries, train, k, exclude_self):
    out = {}
    for i, q in enumerate(queries):
        d = [(float(((q - t) ** 2).sum()), j) for j, t in enumerate(train) if not (exclude_self and i == j)]
        out[i] = [j for _, j in sorted(d)[:k]]
    return out


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("kind", ["continuous", "ternary", "copies"])
def test_blocked_neighbors_are_exact(spark, kind, exclude_self):
    random = np.random.default_rng(1)
    x = random.normal(size=(300, 5))
    if kind == "ternary":
        x = random.integers(-1, 2, size=(300, 4)).astype(float)
    if kind == "copies":
        x[:150] = x[0]
    df = frame(spark, x).select(F.col(KEY).alias("key"), "vector")
    for options in ({}, {"broadcast_numbers": 0, "block_rows": 16}):
        out = nb.knn_join(df, df, 4, exclude_self=exclude_self, **options)
        got = {}
        for r in out.orderBy("key", "distance2", "neighbor").collect():
            got.setdefault(r["key"], []).append(r["neighbor"])
        assert got == brute(x, x, 4, exclude_self)


def test_neighbor_votes(spark, monkeypatch, tmp_path):
    x, y = blobs()
    train, test = frame(spark, x[:90], y[:90]), frame(spark, x[90:], y[90:])
    near = brute(x[90:], x[:90], 5, False)
    wanted = [float(np.bincount(y[near[i]]).argmax()) for i in range(30)]
    small = nb.KNeighbors(k=5).fit(train)
    small.write().overwrite().save(str(tmp_path / "s"))
    monkeypatch.setattr(nb, "BROADCAST_NUMBERS", 10)
    large = nb.KNeighbors(k=5).fit(train)
    assert large.small is None
    large.write().overwrite().save(str(tmp_path / "l"))
    models = [small, large, *[nb.KNeighborsModel.load(str(tmp_path / n)) for n in "sl"]]
    for model in models:
        rows = model.transform(test).orderBy(KEY).collect()
        assert [r["prediction"] for r in rows] == wanted


def test_principal_components(spark, tmp_path):
    x, _ = blobs(60, d=5)
    df = frame(spark, x)
    model = CenteredPCA(k=3).fit(df)
    got = column(model.transform(df), "reduced")
    centred = x - x.mean(0)
    basis = np.linalg.svd(centred, full_matrices=False)[2][:3]
    assert np.allclose(np.abs(got), np.abs(centred @ basis.T))
    Pipeline(stages=[CenteredPCA(k=3)]).fit(df).write().overwrite().save(str(tmp_path / "p"))
    assert np.allclose(column(PipelineModel.load(str(tmp_path / "p")).transform(df), "reduced"), got)
    assert column(CenteredPCA().fit(df).transform(df), "reduced").shape == (60, 5)
    few = frame(spark, x[:4])
    assert CenteredPCA().fit(few).components.shape[1] == 4
    with pytest.raises(ValueError):
        CenteredPCA(k=5).fit(few)


def test_truncated_svd(spark):
    x, _ = blobs(60, d=5)
    df = frame(spark, x)
    got = column(TruncatedSVD(k=2).fit(df).transform(df), "reduced")
    basis = np.linalg.svd(x, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(got), np.abs(x @ basis.T), atol=1e-6)
    flat = frame(spark, np.outer(np.arange(10), [1.0, 2.0, 3.0]))
    assert column(TruncatedSVD(k=2).fit(flat).transform(flat), "reduced").shape == (10, 2)
    for k in (6, None):
        with pytest.raises(ValueError):
            TruncatedSVD(k=k).fit(df)


def plain_isomap(x, k, neighbors):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    g = np.full((n, n), np.inf)
    for i in range(n):
        for j in [j for j in np.argsort(d[i], kind="stable") if j != i][:neighbors]:
            g[i, j] = g[j, i] = d[i, j]
    np.fill_diagonal(g, 0)
    for m in range(n):
        g = np.minimum(g, g[:, m, None] + g[None, m])
    center = np.eye(n) - 1 / n
    values, basis = np.linalg.eigh(-0.5 * center @ g**2 @ center)
    top = np.argsort(values)[::-1][:k]
    return basis[:, top] * np.sqrt(values[top]), g


def test_isomap_with_all_landmarks_is_exact(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(im, "LANES", 8)
    t = np.linspace(0, 4, 30)
    x = np.column_stack([np.cos(t), np.sin(t), 0.1 * np.cos(9 * t)])
    df = frame(spark, np.vstack([x, x[:3]]))
    model = im.Isomap(k=2, neighbors=3, landmarks=100).fit(df)
    got = column(model.transform(df), "reduced")
    wanted, _ = plain_isomap(x, 2, 3)
    assert np.allclose(np.abs(got[:30]), np.abs(wanted), atol=1e-6) and np.allclose(got[30:], got[:3])
    model.write().overwrite().save(str(tmp_path / "i"))
    monkeypatch.setattr(im, "BROADCAST_NUMBERS", 1)
    again = im.IsomapModel.load(str(tmp_path / "i"))
    assert np.allclose(column(again.transform(df), "reduced"), got)
    with pytest.raises(ValueError):
        im.Isomap(k=40, landmarks=100).fit(df)


def test_isomap_bridges_separate_parts(spark):
    random = np.random.default_rng(0)
    x = np.vstack([random.normal(size=(15, 2)), random.normal(size=(15, 2)) + 50, random.normal(size=(6, 2)) - 50])
    got = column(im.Isomap(k=1, neighbors=2, landmarks=4).fit(frame(spark, x)).transform(frame(spark, x)), "reduced")
    assert np.isfinite(got).all()
    a, b = got[:15, 0], got[15:30, 0]
    assert abs(a.mean() - b.mean()) > 5 * max(a.std(), b.std())


def test_most_frequent_breaks_ties(spark, tmp_path):
    df = frame(spark, np.zeros((5, 1)), [2, 1, 2, 1, 0])
    model = MostFrequent().fit(df)
    assert model.label == 1.0
    with pytest.raises(ValueError):
        MostFrequent().fit(df.filter("label > 9"))


@pytest.mark.parametrize("shrinkage", [None, 0.3, 1.0])
def test_discriminant(spark, shrinkage, tmp_path):
    x, y = blobs(90, spread=1.5)
    y = y + 1  # class 0 has no rows
    df = frame(spark, x, y)
    model = LinearDiscriminant(shrinkage=shrinkage).fit(df)
    within = sum(np.cov(x[y == c].T, bias=True) * (y == c).mean() for c in (1, 2, 3))
    s = shrinkage or 0.0
    within = (1 - s) * within + s * np.trace(within) / 6 * np.eye(6)
    means = np.array([x[y == c].mean(0) for c in (1, 2, 3)])
    weights = np.linalg.solve(within, means.T).T
    scores = x @ weights.T - 0.5 * (means * weights).sum(1) + np.log(1 / 3)
    model.write().overwrite().save(str(tmp_path / "m"))
    for m in (model, type(model).load(str(tmp_path / "m"))):
        got = [r["prediction"] for r in m.transform(df).orderBy(KEY).collect()]
        assert got == (scores.argmax(1) + 1).tolist()


def test_linear_margin_reaches_the_minimum(spark):
    x, y = blobs(90, spread=1.5)
    model = LinearMargin(C=0.5).fit(frame(spark, x, y))
    wide = np.column_stack([x, np.ones(len(x))])

    def loss(w, c):
        sign = np.where(y == c, 1.0, -1.0)
        return 0.5 * w @ w + 0.5 * (np.maximum(0, 1 - sign * (wide @ w)) ** 2).sum()

    random = np.random.default_rng(0)
    for c in range(3):
        w = np.append(model.weights[c], model.bias[c])
        base = loss(w, c)
        assert min(loss(w + step * v, c) for v in random.normal(size=(200, 7)) for step in (1e-1, 1e-2)) > base - 1e-6


@pytest.mark.parametrize("kind, workers", [("perceptron", 1), ("perceptron", 6), ("passive_aggressive", 1), ("passive_aggressive", 6)])
def test_online_learners(spark, kind, workers):
    x, y = blobs()
    stage = OnlineLinear(kind=kind, workers=workers, penalty="l2", alpha=1e-5, seed=3)
    model = stage.fit(frame(spark, x, y))
    scored = model.transform(frame(spark, x, y)).select((F.col("label") == F.col("prediction")).cast("int").alias("ok"))
    assert scored.agg(F.avg("ok")).first()[0] > 0.9
    same = stage.fit(frame(spark, x, y).repartition(3))
    assert np.allclose(same.weights, model.weights)


SMALL = {
    "RandomForestClassifier": {"n_estimators": 10, "max_depth": 5},
    "ExtraTreesClassifier": {"n_estimators": 10, "max_depth": 5},
    "GradientBoostingClassifier": {"n_estimators": 3, "max_depth": 2},
    "MLPClassifier": {"hidden_layer_sizes": (8,)},
    "DecisionTreeClassifier": {"max_depth": 5},
}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_every_classifier_learns_and_is_saved(spark, name, tmp_path):
    x, y = blobs(90)
    df = frame(spark, x, y)
    stage = NamedClassifier(name=name, params_=SMALL.get(name, {}), classes=4, seed=1)
    model = Pipeline(stages=[stage]).fit(df)
    rows = model.transform(df).orderBy(KEY).select("label", "prediction").collect()
    right = np.mean([r["label"] == r["prediction"] for r in rows])
    assert right > (0.3 if name == "DummyClassifier" else 0.8)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m")).transform(df).orderBy(KEY).select("label", "prediction").collect()
    assert again == rows


def slow_boosting(x, y, rounds, depth, step=0.1):
    """Scores of all rows by boosting with every midpoint as a candidate, one tree after the other."""
    n, classes = len(x), y.max() + 1
    scores = np.tile(np.log(np.bincount(y) / n), (n, 1))

    def grow(rows, pull, level):
        best = (1e-12, None)
        if level < depth:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    gain = len(a) * len(b) / len(rows) * (pull[a].mean() - pull[b].mean()) ** 2
                    if gain > best[0] + 1e-12:
                        best = (gain, (a, b))
        if best[1] is None:
            curve = (np.abs(pull[rows]) * (1 - np.abs(pull[rows]))).sum()
            return [(rows, (classes - 1) / classes * pull[rows].sum() / curve)]
        return [leaf for side in best[1] for leaf in grow(side, pull, level + 1)]

    for _ in range(rounds):
        chances = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        for k in range(classes):
            for rows, value in grow(np.arange(n), (y == k) - chances[:, k], 0):
                scores[rows, k] += step * value
    return scores


@pytest.mark.parametrize("depth, numbers", [(1, None), (3, None), (3, 0), (None, None)])
def test_boosting_equals_plain_numpy(spark, monkeypatch, depth, numbers):
    """Also with scores renewed in between and with one node a job."""
    monkeypatch.setattr(boosting, "RENEW", 2)
    if numbers is not None:
        monkeypatch.setattr(boosting, "NUMBERS", 50 * 3 * 3)
    random = np.random.default_rng(4)
    x = random.integers(0, 15, (110, 3)) + random.integers(0, 2, (110, 3)) * 0.5
    y = (x[:, 0] > 7).astype(int) + (x[:, 1] + x[:, 2] + random.normal(0, 3, 110) > 16)
    model = boosting.GradientBoosting(rounds=5, depth=depth).fit(frame(spark, x, y).repartition(3))
    want = slow_boosting(x, y, 5, 99 if depth is None else depth)
    if depth is not None:  # without a bound, leaves of one row are reached by different cuts of the same gain
        assert np.allclose(model.scores(x), want)
    assert (model.scores(x).argmax(1) == want.argmax(1)).all()
    found = [r[0] for r in model.transform(frame(spark, x, y)).orderBy(KEY).select("prediction").collect()]
    assert found == model.scores(x).argmax(1).tolist()


def test_boosting_of_odd_tables(spark):
    x, y = blobs(60)
    few = boosting.GradientBoosting(rounds=2, bins=4).fit(frame(spark, x, np.where(y == 1, 3, y)))
    assert few.classes == [0, 2, 3] and max(len(t.feature) for trees in few.rounds for t in trees) > 1
    one = boosting.GradientBoosting(rounds=2).fit(frame(spark, x, np.zeros(len(y))))
    assert one.transform(frame(spark, x, y)).filter("prediction <> 0").count() == 0
    flat = boosting.GradientBoosting(rounds=2).fit(frame(spark, np.ones((6, 2)), np.array([0, 0, 0, 0, 1, 1])))
    assert flat.scores(np.ones((1, 2))).argmax() == 0
    with pytest.raises(ValueError):
        boosting.GradientBoosting().fit(frame(spark, x, y).limit(0))
    assert [len(boosting.cuts_of(np.array(v, float), 3)) for v in ([1], [1, 1], [1, 2, 2, 5], [1, 2, 3, 4, 5])] == [0, 0, 2, 2]


def slow_extra_tree(x, y, tree, seed, depth):
    """Class shares of every row in one tree with the same draws, grown node by node in the order of their numbers."""
    classes, columns = y.max() + 1, int(np.sqrt(x.shape[1]))
    shares, todo, after = np.zeros((len(x), classes)), [(0, np.arange(len(x)), (), 0)], 1
    low, high = x.min(0), x.max(0)
    while todo:
        following = []
        for node, rows, path, attempt in todo:
            counts = np.bincount(y[rows], minlength=classes)
            shares[rows] = counts / len(rows)
            if counts.max() == len(rows) or len(path) >= depth:
                continue
            chosen, cuts = extra_trees.draw(seed, tree, node, attempt, low, high, path, columns)
            options = []
            for column, cut in zip(chosen, cuts):
                side = x[rows, column] <= cut
                if side.any() and not side.all():
                    options.append(sum((np.bincount(y[rows[s]]) ** 2).sum() / s.sum() for s in (side, ~side)))
                else:
                    options.append(-1)
            best = int(np.argmax(options))
            if options[best] < 0:
                if attempt < 19:
                    following.append((node, rows, path, attempt + 1))
                continue
            side = x[rows, chosen[best]] <= cuts[best]
            for right in (0, 1):
                step = (*path, (int(chosen[best]), bool(right), float(cuts[best])))
                following.append((after + right, rows[side != bool(right)], step, 0))
            after += 2
        todo = following
    return shares


@pytest.mark.parametrize("depth, numbers", [(1, None), (4, 1), (None, None)])
def test_extra_trees_equal_plain_numpy(spark, monkeypatch, depth, numbers):
    if numbers is not None:
        monkeypatch.setattr(extra_trees, "NUMBERS", 24)  # a few nodes a job
    random = np.random.default_rng(7)
    x = random.normal(size=(80, 5))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] + random.normal(size=80) * 0.3 > 0.5)
    model = extra_trees.ExtraTrees(trees=6, depth=depth, seed=9).fit(frame(spark, x, y))
    want = sum(slow_extra_tree(x, y, t, 9, 99 if depth is None else depth) for t in range(6)) / 6
    assert np.allclose(model.chances(x), want)
    assert len({t.cut[0] for t in model.trees}) == 6  # each tree has cuts of its own
    forest = NamedClassifier(name="RandomForestClassifier", params_={"n_estimators": 6, "max_depth": 1}, seed=9).fit(frame(spark, x, y))
    midpoints = {round(v, 9) for c in x.T for s in [np.sort(c)] for v in (s[1:] + s[:-1]) / 2}
    assert "RandomForest" in type(forest).__name__ and not midpoints & {round(float(t.cut[0]), 9) for t in model.trees}


@pytest.mark.parametrize("depth, numbers", [(None, None), (2, 24)])
def test_large_forests_grow_in_tasks(spark, tmp_path, monkeypatch, depth, numbers):
    """The driver holds no node, and the forest, its table and a saved copy predict as the small form does."""
    if numbers is not None:
        monkeypatch.setattr(extra_trees, "NUMBERS", numbers)
        monkeypatch.setattr(extra_trees, "QUERY_NUMBERS", 200)  # many chunks
    x, y = blobs(400, spread=2.0)
    x[:6], y = x[0], 2 * y  # copies that nothing divides, and labels that are not 0, 1, 2
    df = frame(spark, x, y).repartition(3).persist()
    stage = extra_trees.ExtraTrees(trees=30, depth=depth, attempts=3, seed=5)
    monkeypatch.setattr(extra_trees, "DRIVER_ROWS", 400 * 30)
    small = stage.fit(df)
    assert len(small.trees) == 30 and small.table is None
    monkeypatch.setattr(extra_trees, "DRIVER_ROWS", 400 * 30 - 1)
    monkeypatch.setattr(extra_trees.ExtraTrees, "_counts", None)
    large = stage.fit(df)
    assert not large.trees and large.table.count() == 30
    assert np.allclose(large.chances(x), small.chances(x), rtol=0, atol=1e-12)
    large.write().save(str(tmp_path / "forest"))
    again = extra_trees.ExtraTreesModel.load(str(tmp_path / "forest"))
    want = small.transform(df).orderBy("case_id").select("case_id", "prediction").collect()
    for model in (large, again):
        assert model.transform(df).orderBy("case_id").select("case_id", "prediction").collect() == want
    assert large.transform(df.limit(0)).count() == 0
    assert {r["prediction"] for r in want} == {0.0, 2.0, 4.0}


def test_extra_trees_of_odd_tables(spark):
    x, y = blobs(30)
    one = extra_trees.ExtraTrees(trees=2).fit(frame(spark, x, np.full(30, 2)))
    assert one.classes == [2] and one.chances(x).min() == 1
    flat = extra_trees.ExtraTrees(trees=2, attempts=2).fit(frame(spark, np.ones((6, 2)), np.array([0, 0, 0, 0, 5, 5])))
    assert flat.classes == [0, 5] and np.allclose(flat.chances(np.ones((1, 2))), [[2 / 3, 1 / 3]])
    with pytest.raises(ValueError):
        extra_trees.ExtraTrees().fit(frame(spark, x, y).limit(0))


@pytest.mark.parametrize("name", ["Perceptron", "PassiveAggressiveClassifier", "LinearSVC", "LinearDiscriminantAnalysis"])
def test_a_class_without_rows_is_never_predicted(spark, name):
    x, y = blobs(90)
    df = frame(spark, x, np.where(y == 1, 3, y))
    model = NamedClassifier(name=name, classes=4, seed=1).fit(df)
    assert model.bias[1] == -np.inf
    assert {r[0] for r in model.transform(df).select("prediction").distinct().collect()} == {0.0, 2.0, 3.0}


@pytest.mark.parametrize("numbers", [None, 0])
def test_neighbors_with_repeated_keys(spark, monkeypatch, numbers):
    """The broadcast form and the large one give the same answers for repeated and missing keys."""
    if numbers is not None:
        monkeypatch.setattr(nb, "BROADCAST_NUMBERS", numbers)
    rows = [(1, [0.0], 0.0), (1, [10.0], 1.0), (None, [20.0], 2.0), (2, [30.0], 3.0)]
    schema = f"{KEY} bigint, v array<double>, label double"
    df = spark.createDataFrame(rows, schema).select(KEY, array_to_vector("v").alias("features"), "label")
    queries = spark.createDataFrame([(7, [1.0], 0.0), (7, [9.0], 1.0), (None, [21.0], 2.0), (8, [29.0], 3.0)], schema)
    model = nb.KNeighbors(k=1).fit(df)
    found = model.transform(queries.select(KEY, array_to_vector("v").alias("features"), "label")).collect()
    assert sorted((r["label"], r["prediction"]) for r in found) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_candidate_lists():
    assert len(candidates(MODELS["RandomForestClassifier"].grid)) == 12
    assert len(candidates(MODELS["DecisionTreeClassifier"].grid)) == 3
    assert depth(30) == 30
    for wrong in (None, 31, 500):
        with pytest.raises(ValueError):
            depth(wrong)
    full = ev.sweep_candidates(**ev.FULL_SWEEP)
    assert len(full) == 13 * (4 + 20 + 16 + 16) and [c.seq for c in full] == list(range(len(full)))
    assert not ev.is_valid(ev.Layout(None, 10)) and not ev.is_valid(ev.Layout("TruncatedSVD", None))
    with pytest.raises(ValueError):
        ev.preprocessing(ev.Layout(None, 10))


def test_queries_search_all_layouts_and_the_whole_grid(monkeypatch):
    from casemill.plans import tuning

    seen = {}

    class Judge:
        def sweep(self, wanted):
            seen["sweep"] = wanted

        def grid_search(self, best, grids):
            seen["grids"] = grids

    monkeypatch.setattr(tuning, "evaluator", lambda spark, sf: Judge())
    monkeypatch.setattr(ev, "best_of_sweep", lambda sweep: sweep)
    tuning._searched(None, None)
    full = {c.layout for c in ev.sweep_candidates(**ev.FULL_SWEEP)}
    for model in ("DummyClassifier", "KNeighborsClassifier", "LinearDiscriminantAnalysis"):
        assert {c.layout for c in seen["sweep"] if c.model == model} == full
    assert seen["grids"] == {n: MODELS[n].grid for n in ("KNeighborsClassifier", "LinearDiscriminantAnalysis")}
    assert seen["sweep"] == ev.sweep_candidates(**tuning.SWEEP)


def test_best_parameters_are_searched_among_all_models(spark, monkeypatch):
    from casemill.plans import tuning

    seen, results = {}, spark.createDataFrame([], ev.RESULT_SCHEMA)

    class Judge:
        def sweep(self, wanted):
            seen["sweep"] = wanted
            return results

        def grid_search(self, best, grids):
            seen["grids"] = grids
            return results

    monkeypatch.setattr(tuning, "evaluator", lambda spark, sf: Judge())
    tuning.best_parameters(spark, None)
    assert seen["sweep"] == ev.sweep_candidates(**ev.FULL_SWEEP) and {c.model for c in seen["sweep"]} == set(ev.FULL_SWEEP["models"])
    assert seen["grids"] == {n: MODELS[n].grid for n in ev.FULL_SWEEP["models"] if n != "DummyClassifier"}


@pytest.fixture(scope="module")
def judged(spark):
    random = np.random.default_rng(4)
    rows = []
    for i in range(80):
        y = i % 2
        present = [f"p{y}{j}" for j in random.integers(0, 3, 3)] + [f"n{random.integers(0, 5)}"]
        rows.append((i, "male" if i % 3 else "female", int(random.integers(1, 900)), present, ["a1"], f"['B{y}']"))
    schema = "case_id long, sex string, age_in_months long, evidence_present array<string>, evidence_absent array<string>, target string"
    labelled, labels = ev.index_labels(spark.createDataFrame(rows, schema), "target")
    assert labels == ["['B0']", "['B1']"]
    cases = ev.with_folds(labelled).persist()
    yield ev.Evaluator(cases, len(labels))
    cases.unpersist()


def test_sweep_tune_pick(spark, judged, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"), "first")
    wanted = ev.sweep_candidates(
        ["DummyClassifier", "LinearDiscriminantAnalysis"], [None, "PCA"], [None, 500], [True], [False]
    )
    assert len(wanted) == 6
    sweep = judged.sweep(wanted, store)
    rows = {r["seq"]: r for r in sweep.collect()}
    # 500 components cannot be had from this data: the candidates are skipped.
    assert sorted(rows) == [0, 1, 3, 4]
    assert rows[0]["mean_test_score"] == 0.5 and rows[3]["mean_test_score"] > 0.9
    assert len(rows[3]["fold_scores"]) == 5
    calls = []
    original = judged.evaluate
    judged.evaluate = lambda wanted, **k: (calls.append([c.seq for c in wanted]), original(wanted, **k))[1]
    assert judged.sweep(wanted, store).count() == 4 and calls == [[2, 5]]
    judged.evaluate = original
    assert ResultStore(spark, str(tmp_path / "results"), "second").read("train_and_evaluate").count() == 0

    best = ev.best_of_sweep(sweep)
    assert [r["model_class"] for r in best.collect()] == ["LinearDiscriminantAnalysis", "DummyClassifier"]
    grid = judged.grid_search(best, {"LinearDiscriminantAnalysis": {"shrinkage": [None, 1.0]}, "SVC": {"C": [1.0]}}, store)
    assert grid.count() == 2
    final = ev.best_parameters(sweep, grid)
    top = final.first()
    assert top["model_class"] == "LinearDiscriminantAnalysis" and "shrinkage" in top["params"]
    assert top["mean_test_score"] == max(r["mean_test_score"] for r in grid.collect())
    series = ev.score_by_parameter(grid, "LinearDiscriminantAnalysis", "shrinkage")
    assert sorted(r["value"] for r in series.collect()) == ["1.0", "null"] and not ev.has_series(series)
    by_column = ev.score_by_parameter(sweep, "DummyClassifier", "count_evidence").collect()
    assert [r["value"] for r in by_column] == ["true"]

    assert store.write_text("best_parameters", final) and not store.write_text("none", final.filter("false"))
    text = spark.read.option("header", True).csv(store.path("best_parameters_csv"))
    assert "model_str" not in text.columns and text.count() == 2

    model = judged.best_predictor(final, str(tmp_path / "model"))
    again = load_model(str(tmp_path / "model"))
    a, b = (m.transform(judged.cases).orderBy(KEY).select("prediction").collect() for m in (model, again))
    assert a == b
    curve = judged.learning_curve(top, [0.5, 1.0]).collect()
    assert [(r["fraction"], r["n_rows"]) for r in curve] == [(0.5, 32)] * 5 + [(1.0, 64)] * 5
    full = [r["test_score"] for r in curve if r["fraction"] == 1.0]
    assert np.mean(full) == pytest.approx(top["mean_test_score"])


def test_own_metric_and_preprocessing(spark, judged):
    wrong = lambda label, prediction: F.avg((label != prediction).cast("double"))
    other = ev.Evaluator(judged.cases, 2, metric=wrong)
    row = other.evaluate([ev.Candidate(0, "DummyClassifier", {}, ev.Layout())]).first()
    assert row["mean_test_score"] == 0.5
    out = ev.fit_transform_features(judged.cases, ev.Layout("PCA", 2, True, True))
    assert column(out, "reduced").shape == (80, 2)


def test_shared_passes_give_what_single_fits_give(spark, judged, monkeypatch):
    """All layouts of three models, against each candidate fitted by itself."""
    from casemill.operators import joint
    from casemill.plans import shared

    wanted = ev.sweep_candidates(
        ["DummyClassifier", "KNeighborsClassifier", "LinearDiscriminantAnalysis"],
        [None, "PCA", "TruncatedSVD", "Isomap"], [2, 5, 300, None], [False], [True],
    )
    more = [{"n_neighbors": k} for k in (1, 3, 50)], [{"shrinkage": s} for s in (0.0, 0.5, 1.0)]
    for name, params in zip(("KNeighborsClassifier", "LinearDiscriminantAnalysis"), more):
        for layout in (ev.Layout(), ev.Layout("PCA", 2)):
            wanted += [ev.Candidate(100 + len(wanted) + i, name, p, layout) for i, p in enumerate(params)]

    def rows(found):
        return {r["seq"]: [r["mean_train_score"], r["mean_test_score"], *(x for s in r["fold_scores"] for x in s)] for r in found.collect()}

    together = rows(judged.evaluate(wanted))
    reasons = {r["seq"]: r["reason"] for r in judged.failed().collect()}
    assert set(together) | set(reasons) == {c.seq for c in wanted} and not set(together) & set(reasons)
    assert {c.layout.n_dimensions for c in wanted if c.seq in reasons} == {300} and all(reasons.values())
    monkeypatch.setattr(shared, "JOINT", {})
    single = rows(judged.evaluate(wanted))
    assert single.keys() == together.keys()
    assert all(together[s] == pytest.approx(single[s]) for s in single)
    monkeypatch.undo()
    # Too much to broadcast: each model in its own form.
    monkeypatch.setattr(joint, "MODEL_NUMBERS", 0)
    monkeypatch.setattr(joint, "BROADCAST_NUMBERS", 0)
    few = [c for c in wanted if c.layout in (ev.Layout(), ev.Layout("PCA", 2))]
    large = rows(judged.evaluate(few))
    assert large == {s: pytest.approx(together[s]) for s in large} and len(large) == len(few)


def test_own_reducers_and_errors(spark, judged, monkeypatch):
    from casemill.operators.reduce import TruncatedSVD as Own

    monkeypatch.setattr(ev, "REDUCERS", dict(ev.REDUCERS))
    ev.register_reducer("Own", lambda n: Own(k=n))
    wanted = [ev.Candidate(i, "LinearDiscriminantAnalysis", {}, ev.Layout(r, 3)) for i, r in enumerate(["Own", "TruncatedSVD"])]
    rows = judged.evaluate(wanted).collect()
    assert rows[0]["mean_test_score"] == pytest.approx(rows[1]["mean_test_score"])

    def broken(label, prediction):
        raise ValueError("not a metric")

    with pytest.raises(ValueError, match="not a metric"):
        ev.Evaluator(judged.cases, 2, metric=broken).evaluate([ev.Candidate(0, "DummyClassifier", {}, ev.Layout())])


@pytest.mark.parametrize("numbers", [None, 0])
def test_isomap_names_rows_by_themselves(spark, monkeypatch, numbers):
    """Repeated and missing keys: every row has its own place, in both forms."""
    if numbers is not None:
        monkeypatch.setattr(im, "BROADCAST_NUMBERS", numbers)
        monkeypatch.setattr(im, "GRAPH_EDGES", numbers)
    random = np.random.default_rng(3)
    x = random.normal(size=(40, 3))
    rows = [(None if i == 5 else i % 7, [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "case_id long, vector array<double>").withColumn("features", array_to_vector("vector"))
    out = im.Isomap(k=2, neighbors=4, landmarks=100).fit(df).transform(df)
    got = {tuple(r["vector"]): r["v"] for r in out.select("vector", vector_to_array("reduced").alias("v")).collect()}
    assert len(got) == 40 and all(v is not None for v in got.values())
    near = [np.argsort([((p - q) ** 2).sum() for q in x])[1:5] for p in x]
    away = np.full((40, 40), np.inf)
    np.fill_diagonal(away, 0)
    for i, js in enumerate(near):
        for j in js:
            away[i, j] = away[j, i] = np.linalg.norm(x[i] - x[j])
    for m in range(40):
        away = np.minimum(away, away[:, [m]] + away[[m], :])
    square = away**2
    center = np.eye(40) - 1 / 40
    values, basis = np.linalg.eigh(-0.5 * center @ square @ center)
    wanted = (basis * np.sqrt(np.maximum(values, 0)))[:, ::-1][:, :2]
    found = np.array([got[tuple(map(float, p))] for p in x])
    assert np.allclose(np.abs(found), np.abs(wanted), atol=1e-6)


def test_repeated_keys_stay_single_rows(spark):
    rows = [(1, 0.0), (1, 1.0), (2, 0.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "case_id long, label double")
    assert ev.with_folds(df, 2).count() == 4


@pytest.mark.parametrize("limit", [0, 10**6])
def test_partial_sums(spark, monkeypatch, limit):
    from casemill.operators import vectors

    monkeypatch.setattr(vectors, "CHUNK", 3)
    monkeypatch.setattr(vectors, "SLOTS", 2)
    monkeypatch.setattr(vectors, "DRIVER_NUMBERS", limit)
    x = np.arange(60.0).reshape(20, 3)
    blocks = vectors.packed(frame(spark, x), "features", F.col("label"))

    def gram(parts):
        return sum((p.T @ p).ravel() for p, _ in parts)

    assert np.allclose(vectors.summed(blocks, gram, 9), (x.T @ x).ravel())
    assert not vectors.summed(blocks.filter("false"), lambda parts: None, 9).any()


def test_back_propagation_is_the_gradient():
    from casemill.operators import network as nw

    random = np.random.default_rng(2)
    sizes, x, y = [4, 5, 3, 6], random.normal(size=(30, 4)), random.integers(0, 6, 30)
    vector = random.normal(size=sum((a + 1) * b for a, b in zip(sizes, sizes[1:])))
    total = nw.loss_and_gradient(vector, sizes, x, y)
    for i in random.permutation(len(vector))[:40]:
        step = np.zeros_like(vector)
        step[i] = 1e-6
        high, low = (nw.loss_and_gradient(vector + s, sizes, x, y)[0] for s in (step, -step))
        assert total[1 + i] == pytest.approx((high - low) / 2e-6, rel=1e-4, abs=1e-5)


def test_strength_of_the_network(spark, tmp_path):
    """A strong L2 term shrinks the weights; the minimum has no gradient; every candidate of the grid can be built."""
    from casemill.operators import network as nw

    x, y = blobs()
    df = frame(spark, x, y)
    models = [nw.Perceptrons(hidden=[8], alpha=a, passes=400).fit(df) for a in (0.1, 100.0)]
    free, held = (np.concatenate([w.ravel() for w, _ in nw.layers_of(m.vector, m.sizes)]) for m in models)
    assert (held @ held) < 0.5 * (free @ free) and all(m.converged for m in models)
    total = nw.loss_and_gradient(models[1].vector, models[1].sizes, x, y) / len(x)
    pull = np.zeros_like(models[1].vector)
    for (w, _), (into, _) in zip(nw.layers_of(models[1].vector, models[1].sizes), nw.layers_of(pull, models[1].sizes)):
        into[...] = w
    assert np.abs(total[1:] + 100.0 / len(x) * pull).max() < 1e-2
    assert len(candidates(MODELS["MLPClassifier"].grid)) == 20


@pytest.mark.parametrize("numbers", [40, 200, 10**6])
def test_groups_of_cells_lose_no_neighbor(spark, monkeypatch, numbers):
    """Cells are put together to tasks of a bounded size, and parts are searched by themselves."""
    monkeypatch.setattr(nb, "TASK_NUMBERS", numbers)
    monkeypatch.setattr(nb, "LEAST_QUERIES", 20)
    random = np.random.default_rng(6)
    x = random.normal(size=(120, 4))
    part = np.where(np.arange(120) < 100, np.arange(120) % 2, 2)
    rows = [(i, [float(v) for v in p], int(c), float(i % 3)) for i, (p, c) in enumerate(zip(x, part))]
    df = spark.createDataFrame(rows, "key long, vector array<double>, part int, label double")
    found = nb.merged(nb.block_join(df.select("key", "vector"), df, 120, 4, 3, block_rows=8), 3).collect()
    got = {(r["key"], r["part"]): [(e["neighbor"], e["label"]) for e in r["near"]] for r in found}
    for p in range(3):
        members = np.flatnonzero(part == p)
        wanted = brute(x, x[members], 3, False)
        assert all(got[i, p] == [(members[j], members[j] % 3) for j in near] for i, near in wanted.items())
    assert len(got) == 360


def test_tasks_do_not_follow_the_cells():
    """Many small cells make few groups: a query is copied to groups, not to cells."""
    random = np.random.default_rng(7)
    pivots, counts = random.normal(size=(500, 3)), random.integers(1, 200, (3, 500))
    counts[2] //= 150
    group = nb.task_groups(pivots, counts, 10_000)
    assert group.max() + 1 <= 3 * counts.sum() / 10_000 + 1
    assert (group[counts == 0] == -1).all() and (group[counts > 0] >= 0).all()
    assert max(counts[group == g].sum() for g in range(group.max() + 1)) <= 10_000


def test_smallest_values_by_strides():
    values = np.random.default_rng(8).integers(0, 50, (40, 3001)).astype(float)
    for many in (1, 7, 40, 400, 5000):
        some = nb.smallest(values, many)
        assert all(len(set(row)) == min(many, 3001) for row in some.tolist())
        assert (np.sort(np.take_along_axis(values, some, 1)) == np.sort(values)[:, :many]).all()


def test_one_search_for_all_folds_and_prefixes(spark, monkeypatch):
    """Too many rows to broadcast: the scores of the folds fitted one by one, from a single search."""
    random = np.random.default_rng(9)
    x, y = random.normal(size=(90, 3)), random.integers(0, 4, 90)
    x[60:] = x[:30]
    rows = [(None if i == 5 else i // 2 if i < 10 else i, [float(v) for v in p], float(c)) for i, (p, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, f"{KEY} long, vector array<double>, label double").withColumn("features", array_to_vector("vector"))
    cases = ev.with_folds(df.persist()).persist()
    wanted = [ev.Candidate(i, "KNeighborsClassifier", {"n_neighbors": k}, ev.Layout()) for i, k in enumerate((1, 5, 100))]
    searches, original = [], nb.block_join
    monkeypatch.setattr(nb, "block_join", lambda *a, **k: (searches.append(1), original(*a, **k))[1])

    def scores():
        judge = ev.Evaluator(cases, 4, features="features", neighbors=[1, 5, 100])
        first = judge.evaluate(wanted[:1])
        grid = judge.evaluate(wanted)
        return first.collect(), grid.collect(), judge.learning_curve(first.first(), [0.5, 1.0]).collect()

    single = scores()
    assert not searches
    monkeypatch.setattr(nb, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(nb, "TASK_NUMBERS", 120)
    assert scores() == single
    assert len(searches) == 2  # the search and the prefixes; folds fitted one by one take 5 for each


def test_the_driver_gets_one_vector_of_a_sum(spark, monkeypatch):
    """Loops that know their partitions: what is sent does not grow with them; units can be finished where they are added."""
    from casemill.operators import vectors

    x = np.arange(240.0).reshape(80, 3)
    blocks = vectors.packed(frame(spark, x), "features", F.col("label")).repartition(8).persist()
    sent, original = [], type(blocks).toArrow
    monkeypatch.setattr(type(blocks), "toArrow", lambda df: (sent.append(original(df)), sent[-1])[1])
    monkeypatch.setattr(vectors, "FEW_NUMBERS", 0)

    def gram(parts):
        found = [(p.T @ p).ravel() for p, _ in parts]
        return sum(found) if found else None

    for limit in (16_000_000, 0):
        monkeypatch.setattr(vectors, "TASK_NUMBERS", limit)
        sent.clear()
        assert np.allclose(vectors.summed(blocks, gram, 9, 8), (x.T @ x).ravel())
        assert sent[0].num_rows == 1
        sums = vectors.summed(blocks, gram, 9, 8, unit=3, finish=lambda row: [row.sum(), row[0]])
        assert np.allclose(sums, np.stack([(x.T @ x).sum(1), (x.T @ x)[:, 0]], axis=1))
        empty = vectors.summed(blocks.filter("false"), lambda parts: None, 9, 8, unit=3, finish=lambda row: [row.sum() + 1])
        assert (empty == 1).all() and empty.shape == (3, 1)


def test_grown_trees_hold_no_counts_of_other_nodes(spark, monkeypatch):
    made = []

    class Kept(extra_trees.Growing):
        def __init__(self):
            super().__init__()
            made.append(self)

    monkeypatch.setattr(extra_trees, "Growing", Kept)
    x, y = blobs(spread=2.0)
    extra_trees.ExtraTrees(trees=3).fit(frame(spark, x, y))
    values = [v for g in made for v in g.value]
    assert len(values) > 20 and all(v.base is None for v in values)


@pytest.mark.parametrize("name", ["DecisionTreeClassifier", "RandomForestClassifier"])
def test_folds_of_trees_are_fitted_at_the_same_time(spark, tmp_path, monkeypatch, name):
    rows = [(i, [float(i), 1.0], i % 2) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    all_in = threading.Barrier(learning.FOLDS, timeout=60)

    class Model:
        def transform(self, df):
            return df.withColumn("prediction", F.col("label"))

    def fit(stage, df):
        all_in.wait()
        return Model()

    monkeypatch.setattr(learning.NamedClassifier, "fit", fit)
    assert learning.predictions(spark, str(tmp_path), name).count() == 20


@pytest.mark.parametrize("layout", [ev.Layout(), ev.Layout(count_evidence=True, include_absent=False)])
def test_one_pass_for_all_prefixes_of_a_discriminant(spark, monkeypatch, layout):
    from casemill.plans import shared

    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        seen = [f"e{j}" for j in range(6) if rng.random() < 0.4]
        gone = [f"e{j}" for j in range(6) if rng.random() < 0.2 and f"e{j}" not in seen]
        if i == 150:  # an id and a category that few sets know
            seen, sex = [*seen, "e9"], "other"
        else:
            sex = None if i == 20 else ["female", "male"][int(rng.integers(2))]
        rows.append((i, sex, int(rng.integers(1, 900)), seen, gone, float(rng.integers(3) if i % 4 else "e0" in seen)))
    schema = "case_id long, sex string, age_in_months int, evidence_present array<string>, evidence_absent array<string>, label double"
    cases = ev.with_folds(spark.createDataFrame(rows, schema), 3).persist()
    passes = []
    taken = shared.SharedDiscriminants._scores
    monkeypatch.setattr(shared.SharedDiscriminants, "_scores", lambda *a: passes.append(len(a[3])) or taken(*a))

    def curve():
        judge = ev.Evaluator(cases, 3, folds=3)
        sweep = judge.sweep([ev.Candidate(0, "LinearDiscriminantAnalysis", {}, layout)])
        found = judge.learning_curve(sweep.first(), [0.5, 0.8, 1.0]).collect()
        assert len(found) == 9
        return [(r["fold"], r["train"], r["test"]) for r in sweep.first()["fold_scores"]], found

    together = curve()
    assert passes == [3, 9]
    monkeypatch.setattr(shared.SharedDiscriminants, "takes", lambda self, c: False)
    assert curve() == together
    monkeypatch.undo()
    monkeypatch.setattr(shared.joint, "MODEL_NUMBERS", 300)  # one set or two in a pass
    assert curve() == together


def test_like_cases_are_predicted_once(spark, monkeypatch):
    """Cases that are encoded alike, whatever the order of their lists, share their predictions; a missing sex is like another."""
    from casemill.plans import shared

    kinds = [(None if i == 3 else "fm"[i % 2], 10 + i // 4, [f"e{j}" for j in range(4) if (i >> j) & 1]) for i in range(16)]
    rows = []
    for i in range(200):
        sex, age, seen = kinds[i * 7 % 16]
        rows.append((i, sex, age, seen[::-1] if i % 3 else seen, [f"e{i}"], float((i * 7 % 16 + (i % 5 == 0)) % 4)))
    schema = "case_id long, sex string, age_in_months int, evidence_present array<string>, evidence_absent array<string>, label double"
    cases = ev.with_folds(spark.createDataFrame(rows, schema), 2).persist()
    seen, taken = [], shared.SharedDiscriminants._scores
    monkeypatch.setattr(shared.SharedDiscriminants, "_scores", lambda *a: seen.append(a[5](1).count()) or taken(*a))
    candidate = ev.Candidate(0, "LinearDiscriminantAnalysis", {}, ev.Layout(include_absent=False))
    together = ev.Evaluator(cases, 4, folds=2).sweep([candidate]).first()["fold_scores"]
    assert seen == [16]
    monkeypatch.setattr(shared.SharedDiscriminants, "takes", lambda self, c: False)
    assert ev.Evaluator(cases, 4, folds=2).sweep([candidate]).first()["fold_scores"] == together


@pytest.mark.parametrize("kind", ["ties", "noise", "far"])
def test_rough_search_loses_no_neighbor(monkeypatch, kind):
    """Leading columns from one pass in single precision, against all distances; far from zero its margin is too wide."""
    monkeypatch.setattr(nb, "TILE_QUERIES", 50)
    monkeypatch.setattr(nb, "TILE_ROWS", 128)
    random = np.random.default_rng(3)
    x = random.integers(-1, 2, size=(700, 9)).astype(float)
    if kind != "ties":
        x = random.normal(size=x.shape) * (1e-6 if kind == "far" else 1.0)
    x[0] += 1e6 * (kind == "far")
    ids = random.permutation(len(x))
    search = nb.Search(x, ids, [(3, 2), (6, 7), (9, 4)])
    assert search.rough
    for own in (None, ids):
        for (n, k), (places, away) in zip(search.wanted, search.nearest(x, own)):
            squares = ((x[:, None, :n] - x[None, :, :n]) ** 2).sum(axis=2)
            if own is not None:
                np.fill_diagonal(squares, np.inf)
            wanted = np.lexsort((np.broadcast_to(ids, squares.shape), squares))[:, :k]
            assert (places == wanted).all()
            assert np.allclose(away, np.take_along_axis(squares, wanted, 1), rtol=1e-9, atol=0)


def test_paths_settle_from_what_moved():
    random = np.random.default_rng(5)
    away = np.where(random.random((30, 30)) < 0.1, random.random((30, 30)), np.inf)
    away = np.minimum(away, away.T)
    src, dst = np.nonzero(np.isfinite(away))
    first = np.searchsorted(src, np.arange(31))
    start = np.where(np.arange(30) == 4, 0.0, np.inf)
    found = im.settled(start.copy(), first, dst, away[src, dst])
    for _ in range(30):
        start = np.minimum(start, (start[:, None] + away).min(axis=0))
    assert (found == start).all()


def test_neighbors_of_all_layouts_share_one_search(spark, monkeypatch):
    """Tables beyond the broadcast of a single classifier are not fitted layout by layout; repeated rows and keys count as rows."""
    from casemill.operators import joint
    from casemill.plans import shared

    random = np.random.default_rng(8)
    rows = []
    for i in range(90):
        y = int(random.integers(0, 3))
        present = [f"p{y}"] if i % 3 else [f"p{random.integers(0, 3)}"]
        rows.append((i % 80 if i else None, "male" if i % 2 else "female", int(random.integers(1, 4)), present, [], float(y)))
    schema = "case_id long, sex string, age_in_months long, evidence_present array<string>, evidence_absent array<string>, label double"
    cases = spark.createDataFrame(rows, schema).withColumn("fold", F.coalesce(F.col("case_id") % 2, F.lit(0)).cast("int")).persist()
    judge = ev.Evaluator(cases, 3, folds=2)
    layouts = [ev.Layout(), ev.Layout("Isomap", 2)]
    wanted = [ev.Candidate(2 * i + j, "KNeighborsClassifier", {"n_neighbors": k}, layout) for i, layout in enumerate(layouts) for j, k in enumerate((3, 30))]

    def scores():
        return {r["seq"]: [x for s in r["fold_scores"] for x in s] for r in judge.evaluate(wanted).collect()}

    with monkeypatch.context() as m:
        m.setattr(shared, "JOINT", {})
        single = scores()
    monkeypatch.setattr(joint, "BROADCAST_NUMBERS", 0)
    with monkeypatch.context() as m:
        m.setattr(nb.KNeighbors, "_fit", lambda *_: pytest.fail("fitted by itself"))
        together = scores()
    monkeypatch.setattr(joint, "POINT_NUMBERS", 0)
    large = scores()
    assert len(single) == 4
    for found in (together, large):
        assert found == {s: pytest.approx(v) for s, v in single.items()}
    cases.unpersist()
