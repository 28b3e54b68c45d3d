"""Vocabulary, ternary encoding and counts."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array

from casemill.operators import evidence as ev
from casemill.operators.features import CaseScaler, feature_stages

SCHEMA = "case_id long, evidence_present array<string>, evidence_absent array<string>"


def encoded(df):
    return {r["case_id"]: r["v"] for r in df.select("case_id", vector_to_array("evidence").alias("v")).collect()}


@pytest.fixture()
def cases(spark):
    rows = [(1, ["b", "a", "a"], ["a", "d"]), (2, ["c"], []), (3, [], None), (4, None, ["b"])]
    return spark.createDataFrame(rows, SCHEMA)


def test_encoder(spark, cases):
    model = ev.EvidenceEncoder(countEvidence=True).fit(cases)
    assert model.ids == ["a", "b", "c", "d"]
    out = model.transform(cases)
    assert encoded(out) == {1: [-1, 1, 0, -1], 2: [0, 0, 1, 0], 3: [0] * 4, 4: [0, -1, 0, 0]}
    counts = {r["case_id"]: (r[ev.PRESENT_COUNT], r[ev.ABSENT_COUNT]) for r in out.collect()}
    assert counts == {1: (3, 2), 2: (1, 0), 3: (0, 0), 4: (0, 1)}


def test_present_only(spark, cases):
    model = ev.EvidenceEncoder(includeAbsentEvidence=False, countEvidence=True).fit(cases)
    assert model.ids == ["a", "b", "c"]
    out = model.transform(cases)
    assert encoded(out)[1] == [1, 1, 0] and ev.ABSENT_COUNT not in out.columns


def test_unknown_ids(spark, cases):
    new = spark.createDataFrame([(9, ["x", "x"], [])], SCHEMA)
    ignoring = ev.EvidenceEncoder(countEvidence=True).fit(cases).transform(new)
    assert encoded(ignoring)[9] == [0, 0, 0, 0] and ignoring.first()[ev.PRESENT_COUNT] == 2
    strict = ev.EvidenceEncoder(handleUnknown="error").fit(cases)
    with pytest.raises(Exception, match="not in the fitted vocabulary: x"):
        strict.transform(new).collect()
    with pytest.raises(Exception, match="not in the fitted vocabulary: x"):
        strict.transform_long(new).collect()
    with pytest.raises(ValueError, match="handle_unknown"):
        ev.EvidenceEncoder(handleUnknown="drop").fit(cases)
    with pytest.raises(RuntimeError, match="fit"):
        ev.EvidenceEncoderModel().transform(cases)


def test_long_form_agrees(spark, cases):
    model = ev.EvidenceEncoder().fit(cases)
    table = ev.explode_lists(cases)
    known = ev.vocabulary(table)
    assert [r["evidence_id"] for r in known.orderBy("idx").collect()] == model.ids
    a = sorted(map(tuple, model.transform_long(cases).collect()))
    b = sorted(map(tuple, ev.encode_long(table, known).collect()))
    vectors = encoded(model.transform(cases))
    c = sorted((i, model.ids[j], int(v)) for i, row in vectors.items() for j, v in enumerate(row) if v)
    assert a == b == c
    unknown = spark.createDataFrame([(1, "zz", "present")], "case_id long, evidence_id string, state string")
    assert ev.encode_long(unknown, known).count() == 0
    with pytest.raises(Exception, match="not in the fitted vocabulary: zz"):
        ev.encode_long(unknown, known, handle_unknown="error").collect()


def test_vocabulary_positions_over_many_slices(spark):
    ids = sorted({f"e{i * 7919 % 5000}" for i in range(3000)})
    rows = [(i, x, "present") for i, x in enumerate(ids + ids[:50])]
    df = spark.createDataFrame(rows, "case_id long, evidence_id string, state string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ev.vocabulary(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["idx"], r["evidence_id"]) for r in out) == list(enumerate(ids))


def test_random_lists_against_plain_python(spark):
    random = np.random.default_rng(3)
    ids = [f"s_{i}" for i in range(40)]
    pick = lambda: [ids[i] for i in random.integers(0, 40, random.integers(0, 12))]
    rows = [(i, pick(), pick()) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = ev.EvidenceEncoder().fit(df)
    got = encoded(model.transform(df))
    for i, present, absent in rows:
        row = dict.fromkeys(model.ids, 0) | dict.fromkeys(present, 1) | dict.fromkeys(absent, -1)
        assert got[i] == [row[x] for x in model.ids]


def test_scaling_rules(spark):
    rows = [(1, "male", 1, 2), (2, "female", 3, 2), (3, None, 8, 2)]
    df = spark.createDataFrame(rows, "case_id long, sex string, age_in_months long, n int")
    model = CaseScaler(countCols=["n"]).fit(df)
    assert round(model.state["std"], 6) == 2.943920
    out = {r["case_id"]: r for r in model.transform(df).collect()}
    assert [out[i]["sex_code"] for i in (1, 2, 3)] == [1.0, 0.0, -1.0]
    assert [out[i]["n_scaled"] for i in (1, 2, 3)] == [-1.0] * 3
    assert np.allclose([out[i]["age_scaled"] for i in (1, 2, 3)], (np.array([1, 3, 8]) - 4) / 2.943920, atol=1e-5)
    other = spark.createDataFrame([(4, "other", 4, 2)], df.schema)
    assert model.transform(other).first()["sex_code"] == -1.0


@pytest.mark.parametrize("count, absent, width", [(True, True, 8), (True, False, 6), (False, True, 6), (False, False, 5)])
def test_assembly_and_saving(spark, tmp_path, count, absent, width):
    rows = [(1, "male", 10, ["b", "a"], ["d"]), (2, "female", 30, ["c"], [])]
    df = spark.createDataFrame(rows, "case_id long, sex string, age_in_months long, evidence_present array<string>, evidence_absent array<string>")
    model = Pipeline(stages=feature_stages(count, absent)).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    for m in (model, again):
        first = m.transform(df).orderBy("case_id").select(vector_to_array("features").alias("v")).first()["v"]
        counts = ([1.0] + ([1.0] if absent else [])) if count else []
        assert len(first) == width
        assert first == [1.0, -1.0, *counts, 1.0, 1.0, 0.0, *([-1.0] if absent else [])]
