"""Raw nested cases to features and target: one narrow plan, without any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casemill.functions.scalar import age_in_months, ids_of, list_label
from casemill.operators.range_lookup import (
    ICD10_RANGES,
    Range,
    blocks_of_codes,
    blocks_of_codes_joined,
    small_ranges,
)
from casemill.operators.splits import holdout_split
from casemill.schema import KEY, TARGET
from casemill.session import write_through
from casemill.sources.cases import read_cases, read_chapters, require_rows

FEATURES = ["sex", "age_in_months", "evidence_present", "evidence_absent"]


def target_column(codes: Column, ranges: Sequence[Range], multi_label: bool, **options) -> Column:
    blocks = blocks_of_codes(codes, ranges, **options)
    return blocks if multi_label else list_label(blocks)


def case_table(
    raw: DataFrame,
    ranges: Sequence[Range] | DataFrame = ICD10_RANGES,
    multi_label: bool = False,
    category_only: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Key, features and target of raw cases.

    Columns that describe the answer or the prediction (names, sources, predictions) are not
    selected, so the scan does not read them. The target is a list of blocks with
    ``multi_label`` and its rendered label otherwise. A range table given as a DataFrame is
    inlined while it is small and joined otherwise.
    """
    large = None
    if isinstance(ranges, DataFrame):
        inlined = small_ranges(ranges)
        large, ranges = (ranges, []) if inlined is None else (None, inlined)
    codes = F.col("expected_condition_icd10_codes")
    age = F.col("api_payload.age")
    if large is not None:
        target = codes.alias("_codes")
    else:
        target = target_column(
            codes, ranges, multi_label, category_only=category_only, strict=strict
        ).alias(TARGET)
    table = raw.select(
        F.col("public_test_case_id").alias(KEY),
        F.col("api_payload.sex").alias("sex"),
        age_in_months(age["value"], age["unit"]).alias("age_in_months"),
        ids_of(F.col("evidence.present")).alias("evidence_present"),
        ids_of(F.col("evidence.absent")).alias("evidence_absent"),
        target,
    )
    if large is None:
        return table
    # Rows with the same case id are different rows.
    numbered = write_through(table.withColumn("_row", F.monotonically_increasing_id()))
    joined = blocks_of_codes_joined(numbered, "_row", "_codes", large, category_only, "_blocks").drop("_row")
    blocks = F.col("_blocks")
    if strict:
        failure = F.raise_error(F.lit("a code has no block")).cast("array<string>")
        blocks = F.when(F.exists(blocks, lambda b: b.isNull()), failure).otherwise(blocks)
    final = blocks if multi_label else list_label(blocks)
    return joined.withColumn(TARGET, final).drop("_codes", "_blocks")


def features_and_target(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into X and y; both carry the key, as Spark rows have no index."""
    return table.select(KEY, *FEATURES), table.select(KEY, TARGET)


def load_cases(
    spark: SparkSession,
    data_path: str,
    chapters_path: str | None = None,
    multi_label: bool = False,
    test_size: float | None = None,
    layout: str = "json",
    seed: int = 0,
    **options,
):
    """``(X, y)``, or ``(X_train, X_test, y_train, y_test)`` with a ``test_size``."""
    ranges = ICD10_RANGES if chapters_path is None else read_chapters(spark, chapters_path)
    raw = require_rows(read_cases(spark, data_path, layout))
    table = case_table(raw, ranges, multi_label, **options)
    if test_size is None:
        return features_and_target(table)
    parted = holdout_split(table, KEY, test_size, seed)
    x_train, y_train = features_and_target(parted.filter("split = 'train'"))
    x_test, y_test = features_and_target(parted.filter("split = 'test'"))
    return x_train, x_test, y_train, y_test
