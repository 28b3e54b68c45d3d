"""Loading, labels, range lookup and age rules."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.functions.scalar import age_in_months, list_label, list_length, to_number
from casemill.operators.range_lookup import (
    ICD10_RANGES,
    Range,
    block_mask,
    blocks_of_codes,
    blocks_of_mask,
    first_range,
    label_of_mask,
    range_lookup,
)
from casemill.plans.load import case_table, load_cases
from casemill.schema import CASE_SCHEMA, ICD10_BLOCKS, TARGET
from casemill.sources.cases import builtin_chapters, read_cases, read_chapters


def case(i, codes, present=(), absent=(), sex="female", age=11, unit="year"):
    item = lambda x: {"id": x, "name": x, "type": "symptom", "initial": False}
    return {
        "public_test_case_id": i,
        "public_test_case_name": f"case {i}",
        "expected_condition_name": "x",
        "expected_condition_icd10_codes": list(codes),
        "evidence": {"present": [item(x) for x in present], "absent": [item(x) for x in absent], "unknown": []},
        "test_case_passed": True,
        "predicted_conditions": [{"id": "c_1", "name": "y", "common_name": "z", "probability": 0.5}],
        "api_payload": {
            "sex": sex,
            "age": {"value": age, "unit": unit},
            "evidence": [{"id": x, "choice_id": "present"} for x in present],
        },
    }


@pytest.fixture()
def raw_file(tmp_path):
    path = tmp_path / "cases.json"
    cases = [
        case(1, ["N10", "A01", "A02"], ["s_1", "s_2"], ["s_3"]),
        case(2, ["B99.9"], age=11, unit="month"),
        case(3, [], sex="male", unit=None),
        case(4, ["B99.9", "A00"]),
    ]
    path.write_text(json.dumps(cases), encoding="utf8")
    return str(path)


def test_load_json(spark, raw_file):
    x, y = load_cases(spark, raw_file)
    assert x.columns == ["case_id", "sex", "age_in_months", "evidence_present", "evidence_absent"]
    rows = {r["case_id"]: r for r in x.collect()}
    assert [rows[i]["age_in_months"] for i in (1, 2, 3)] == [138, 11, 11]
    assert rows[1]["evidence_present"] == ["s_1", "s_2"] and rows[1]["evidence_absent"] == ["s_3"]
    labels = {r["case_id"]: r[TARGET] for r in y.collect()}
    assert labels == {1: "['A00-B99', 'N00-N99']", 2: "[None]", 3: "[]", 4: "['A00-B99', None]"}


def test_multi_label_and_other_layouts(spark, raw_file, tmp_path):
    _, y = load_cases(spark, raw_file, multi_label=True)
    assert {r["case_id"]: r[TARGET] for r in y.collect()}[4] == ["A00-B99", None]
    raw = read_cases(spark, raw_file)
    raw.write.parquet(str(tmp_path / "p"))
    raw.write.json(str(tmp_path / "j"))
    for folder, layout in (("p", "parquet"), ("j", "jsonl")):
        again = read_cases(spark, str(tmp_path / folder), layout)
        assert again.schema == CASE_SCHEMA
        assert sorted(map(str, case_table(again).collect())) == sorted(map(str, case_table(raw).collect()))
    with pytest.raises(ValueError):
        read_cases(spark, raw_file, "xml")


def test_options_and_guards(spark, raw_file, tmp_path):
    _, y = load_cases(spark, raw_file, category_only=True)
    assert {r["case_id"]: r[TARGET] for r in y.collect()}[2] == "['A00-B99']"
    with pytest.raises(Exception, match="no block for code"):
        load_cases(spark, raw_file, strict=True)[1].collect()
    empty = tmp_path / "empty.json"
    empty.write_text("[]")
    with pytest.raises(ValueError, match="no cases"):
        load_cases(spark, str(empty))
    parts = load_cases(spark, raw_file, test_size=0.3)
    assert [p.count() for p in parts] == [2, 2, 2, 2]


def test_chapter_file(spark, raw_file, tmp_path):
    path = tmp_path / "chapters.csv"
    path.write_text('block,title\nA00-N99,"one, two"\nA00-B99,"three"\n')
    table = read_chapters(spark, str(path))
    assert [tuple(r) for r in table.orderBy("pos").collect()][0][1:] == ("A00-N99", "A00", "N99", "one, two")
    _, y = load_cases(spark, raw_file, str(path))
    assert {r["case_id"]: r[TARGET] for r in y.collect()}[1] == "['A00-N99']"
    # More ranges than are inlined: the joined form gives the same labels.
    many = [f"{b},t" for b in ICD10_BLOCKS] + [f"{x}-{x},t" for x in (f"AA{i:02d}" for i in range(80))]
    path.write_text("block,title\n" + "\n".join(many) + "\n")
    for strict in (False, True):
        _, y = load_cases(spark, raw_file, str(path), strict=strict)
        if strict:
            with pytest.raises(Exception, match="no block"):
                y.collect()
        else:
            expected = {r["case_id"]: r[TARGET] for r in load_cases(spark, raw_file)[1].collect()}
            assert {r["case_id"]: r[TARGET] for r in y.collect()} == expected


def test_no_unused_columns_are_read(spark, raw_file, tmp_path):
    read_cases(spark, raw_file).write.parquet(str(tmp_path / "p"))
    plan = case_table(read_cases(spark, str(tmp_path / "p"), "parquet"))._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "predicted_conditions" not in scan and "public_test_case_name" not in scan
    assert "Exchange" not in plan.split("Physical Plan")[1]


@pytest.mark.parametrize(
    "code, block",
    [
        ("B99", "A00-B99"), ("B99.9", None), ("O9A", "O00-O9A"), ("O9A.1", None), ("D49.2", None),
        ("D50", "D50-D89"), ("A00", "A00-B99"), ("a00", None), ("Y99", "V00-Y99"), ("", None),
    ],
)
def test_first_range(spark, code, block):
    df = spark.createDataFrame([(code,)], "code string")
    assert df.select(first_range(F.col("code"), ICD10_RANGES)).first()[0] == block
    assert range_lookup(df, "code", builtin_chapters(spark)).first()["block"] == block


def test_inlined_ranges_against_a_plain_scan(spark):
    random = np.random.default_rng(2)
    word = lambda: "".join(random.choice(list("AB1é"), random.integers(1, 3)))
    ranges = [Range(*sorted((word(), word()), key=lambda t: t.encode()), f"v{i}") for i in range(12)]
    keys = ["", "~", None, *{word() for _ in range(200)}, *[r.lo for r in ranges], *[r.hi for r in ranges]]
    df = spark.createDataFrame([(k,) for k in keys], "code string")
    found = df.select("code", first_range(F.col("code"), ranges).alias("b")).collect()
    for code, block in found:
        inside = lambda r: r.lo.encode() <= code.encode() <= r.hi.encode()  # noqa: E731,B023
        assert block == next((r.value for r in ranges if code is not None and inside(r)), None)
    assert df.select(first_range(F.col("code"), []).alias("b")).distinct().collect() == [(None,)]


def test_block_masks(spark):
    rows = [(1, "N10"), (1, "A01"), (1, "A01"), (2, "B99.9"), (2, "A00"), (3, "zzz")]
    df = spark.createDataFrame(rows, "case_id long, code string")
    masks = df.groupBy("case_id").agg(F.bit_or(block_mask(F.col("code"))).alias("m"))
    masks = masks.unionByName(spark.createDataFrame([(4, None)], masks.schema))
    out = masks.select("case_id", blocks_of_mask(F.col("m")).alias("b"), label_of_mask(F.col("m")).alias("l"))
    got = {r["case_id"]: (r["b"], r["l"]) for r in out.collect()}
    assert got == {
        1: (["A00-B99", "N00-N99"], "['A00-B99', 'N00-N99']"),
        2: (["A00-B99", None], "['A00-B99', None]"),
        3: ([None], "[None]"),
        4: ([], "[]"),
    }
    assert out.filter(list_label(F.col("b")) != F.col("l")).count() == 0


def test_overlapping_ranges_first_wins(spark):
    ranges = [(i, f"k{i:03d}", f"m{i:03d}", f"v{i}") for i in range(200)] + [(200, "A", "z", "all")]
    table = spark.createDataFrame(ranges, "pos long, lo string, hi string, block string")
    keys = [("k000",), ("k150",), ("l5",), ("m199",), ("B",), ("~",), (None,)]
    df = spark.createDataFrame(keys, "code string")
    found = {r["code"]: r["block"] for r in range_lookup(df, "code", table).collect()}
    brute = {
        k: next((b for _, lo, hi, b in ranges if k is not None and lo <= k <= hi), None) for (k,) in keys
    }
    assert found == brute


def test_scalars(spark):
    df = spark.createDataFrame([(11, "year", ["a"], "1.5"), (11, None, None, "(5,)")], "v long, u string, l array<string>, t string")
    rows = df.select(
        age_in_months(F.col("v"), F.col("u")).alias("m"), list_length(F.col("l")).alias("n"), to_number(F.col("t")).alias("x")
    ).collect()
    assert [tuple(r) for r in rows] == [(138, 1, 1.5), (11, 0, None)]
    assert df.select(list_label(blocks_of_codes(F.array().cast("array<string>")))).first()[0] == "[]"
