"""Profiles, ranks, folds, splits, best rows and overlays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.operators import profile as pr, ranking as rk, splits as sp


def simulated_folds(labels, k=5):
    """Deal the class-sorted rows out in turn, then let each class fill its folds in order."""
    first_seen = {}
    for y in labels:
        first_seen.setdefault(y, len(first_seen))
    codes = [first_seen[y] for y in labels]
    ordered = sorted(codes)
    share = [[ordered[i::k].count(c) for c in range(len(first_seen))] for i in range(k)]
    queues = {c: [i for i in range(k) for _ in range(share[i][c])] for c in range(len(first_seen))}
    return [queues[c].pop(0) for c in codes]


@pytest.mark.parametrize("seed, classes", [(0, 3), (1, 17), (2, 1)])
@pytest.mark.parametrize("buckets", [1, 7])
def test_folds_follow_the_sequential_rule(spark, seed, classes, buckets):
    random = np.random.default_rng(seed)
    # One class holds about half of the rows.
    labels = [int(x) if random.random() < 0.5 else 0 for x in random.integers(0, classes, 403)]
    df = spark.createDataFrame([(i * 3, y) for i, y in enumerate(labels)], "case_id long, label int")
    out = sp.stratified_folds(df.repartition(5), "case_id", "label", buckets=buckets)
    got = [r["fold"] for r in out.orderBy("case_id").collect()]
    assert got == simulated_folds(labels)


@pytest.mark.parametrize("n, size", [(100, 0.25), (7, 0.3), (1, 0.5), (1000, 0.001)])
def test_holdout_is_exact(spark, n, size):
    df = spark.range(n).withColumnRenamed("id", "case_id")
    out = sp.holdout_split(df, "case_id", size, seed=1)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts.get("test", 0) == math.ceil(n * size) and sum(counts.values()) == n
    same = sp.holdout_split(df.repartition(3), "case_id", size, seed=1)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, same.collect()))


@pytest.mark.parametrize("buckets", [1, 6])
def test_prefixes(spark, buckets):
    random = np.random.default_rng(5)
    folds = random.integers(0, 5, 203).tolist()
    df = spark.createDataFrame([(i * 2 + 1, f) for i, f in enumerate(folds)], "case_id long, fold int")
    cuts = sp.prefix_cutoffs(df, "case_id", [0.5, 1.0], buckets=buckets).collect()
    rows = sum(f != 0 for f in folds)
    for c in cuts:
        train = [i * 2 + 1 for i, f in enumerate(folds) if f != c["fold"]]
        assert c["n_rows"] == math.floor(rows * c["fraction"])
        assert c["cutoff_key"] == train[c["n_rows"] - 1]
    assert len(cuts) == 10 or all(sum(f != i for f in folds) < rows for i in range(5))


def test_best_rows(spark):
    rows = [(0, "a", None), (1, "a", 0.4), (2, "a", 0.4), (3, "b", float("nan")), (4, "b", 0.1), (5, "c", None)]
    df = spark.createDataFrame(rows, "seq long, g string, s double")
    best = {r["g"]: r["seq"] for r in rk.best_per_group(df, "g", "s").collect()}
    assert best == {"a": 1, "b": 4, "c": 5}
    assert rk.best_per_group(df, None, "s").first()["seq"] == 1
    assert rk.best_per_group(df.filter("seq > 9"), None, "s").count() == 0
    assert [r["seq"] for r in rk.by_score(df.filter("s is null or s = s"), "s").collect()][-1] == 5


def test_overlay(spark):
    old = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "m string, s double")
    new = spark.createDataFrame([("a", 0.6, "p"), ("b", None, "q"), ("z", 1.0, "r")], "m string, s double, p string")
    out = rk.overlay(old, new, "m", ["s"], extra=["p"])
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 0.6, "p"), ("b", 0.5, "q"), ("c", 0.5, None)]


def test_mean_and_std(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 9.0)], "k string, v double")
    out = {r["k"]: (r["v_mean"], r["v_std"]) for r in rk.mean_and_std(df, "k", ["v"]).collect()}
    assert out == {"a": (2.0, pytest.approx(math.sqrt(2))), "b": (5.0, 0.0)}


def test_functional_dependency(spark):
    rows = [(1, "x", ["p"], None), (1, "x", ["p"], "u"), (2, "x", ["q"], "u"), (2, "y", ["q"], None), (None, "z", ["r"], "v")]
    df = spark.createDataFrame(rows, "k int, a string, b array<string>, c string")
    out = {r["column"]: r["derivable"] for r in pr.derivable(df, "k", ["a", "b", "c"]).collect()}
    assert out == {"a": False, "b": True, "c": True}


def test_profile(spark):
    rows = [(1, "x", [1]), (2, "x", [1]), (3, None, [2]), (3, "y", None)]
    df = spark.createDataFrame(rows, "n int, s string, l array<int>")
    out = {r["column"]: r for r in pr.profile(df).collect()}
    assert (out["n"]["n_distinct"], out["n"]["q50"], out["n"]["max"]) == (3, 2.0, 3.0)
    assert (out["s"]["n_missing"], out["s"]["n_distinct"], out["s"]["top_value"], out["s"]["top_n"]) == (1, 2, "x", 2)
    assert (out["l"]["n_missing"], out["l"]["distinct_share"]) == (1, 0.5)
    assert "q50" not in pr.profile(df, minimal=True).columns
    assert pr.count_rare(df, "s", 2).first()["n_rare"] == 1
    assert pr.duplicate_rows(df.select("s")).first()["n_duplicate_rows"] == 1
    assert pr.histogram(df, ["n"], bins=2).filter("bin = 1").first()["n"] == 3
    assert pr.correlations(df.select("n", (F.col("n") * 2).alias("m"))).first()["corr"] == pytest.approx(1.0)
