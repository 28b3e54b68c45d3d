"""Schemas of raw cases and result rows, and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "case_id"
TARGET = "expected_condition_icd10_blocks"

_EVIDENCE_ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("initial", T.BooleanType()),
    ]
)

CASE_SCHEMA = T.StructType(
    [
        T.StructField("public_test_case_id", T.LongType()),
        T.StructField("public_test_case_name", T.StringType()),
        T.StructField("public_test_case_source", T.StringType()),
        T.StructField("expected_condition_name", T.StringType()),
        T.StructField("expected_condition_common_name", T.StringType()),
        T.StructField("expected_condition_id", T.StringType()),
        T.StructField("expected_condition_position_range", T.StringType()),
        T.StructField("expected_condition_icd10_codes", T.ArrayType(T.StringType())),
        T.StructField(
            "evidence",
            T.StructType(
                [
                    T.StructField("present", T.ArrayType(_EVIDENCE_ITEM)),
                    T.StructField("absent", T.ArrayType(_EVIDENCE_ITEM)),
                    T.StructField("unknown", T.ArrayType(_EVIDENCE_ITEM)),
                ]
            ),
        ),
        T.StructField("test_case_passed", T.BooleanType()),
        T.StructField(
            "predicted_conditions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("common_name", T.StringType()),
                        T.StructField("probability", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "api_payload",
            T.StructType(
                [
                    T.StructField("sex", T.StringType()),
                    T.StructField(
                        "age",
                        T.StructType(
                            [
                                T.StructField("value", T.LongType()),
                                T.StructField("unit", T.StringType()),
                            ]
                        ),
                    ),
                    T.StructField(
                        "evidence",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("id", T.StringType()),
                                    T.StructField("choice_id", T.StringType()),
                                    T.StructField("source", T.StringType()),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
    ]
)

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("model_class", T.StringType()),
        T.StructField("model_str", T.StringType()),
        T.StructField("dim_reduction_algorithm", T.StringType()),
        T.StructField("n_dimensions", T.IntegerType()),
        T.StructField("count_evidence", T.BooleanType()),
        T.StructField("include_absent_evidence", T.BooleanType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("mean_train_score", T.DoubleType()),
        T.StructField("mean_test_score", T.DoubleType()),
        T.StructField(
            "fold_scores",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("fold", T.IntegerType()),
                        T.StructField("train", T.DoubleType()),
                        T.StructField("test", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)

# The ICD-10-CM chapter blocks, in file order.
ICD10_BLOCKS = (
    "A00-B99",
    "C00-D49",
    "D50-D89",
    "E00-E89",
    "F01-F99",
    "G00-G99",
    "H00-H59",
    "H60-H95",
    "I00-I99",
    "J00-J99",
    "K00-K95",
    "L00-L99",
    "M00-M99",
    "N00-N99",
    "O00-O9A",
    "P00-P96",
    "Q00-Q99",
    "R00-R99",
    "S00-T88",
    "U00-U85",
    "V00-Y99",
    "Z00-Z99",
)
