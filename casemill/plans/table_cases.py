"""Cases derived from the order tables: people, evidence and codes as long tables.

An order is a case, its lines are evidence, its first two line numbers carry codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casemill.functions.scalar import age_in_months
from casemill.operators.evidence import ABSENT_COUNT, PRESENT_COUNT
from casemill.operators.range_lookup import block_mask, blocks_of_mask, label_of_mask
from casemill.schema import KEY, TARGET


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def people(spark: SparkSession, folder: str) -> DataFrame:
    customer = F.col("o_custkey")
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(KEY),
        F.when(customer % 2 == 0, "female").otherwise("male").alias("sex"),
        (1 + customer % 90).alias("age"),
        F.when(customer % 10 == 0, "month").otherwise("year").alias("unit"),
    )


def with_age(table: DataFrame) -> DataFrame:
    return table.withColumn("age_in_months", age_in_months(F.col("age"), F.col("unit"))).drop("age", "unit")


def _lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    part = read_table(spark, folder, "part").select("p_partkey", "p_size")
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", *columns)
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """``case_id, evidence_id, state``, one row per line that is present or absent.

    No operator uses unknown evidence, so the flag is filtered in the scan.
    """
    flag = F.col("l_returnflag")
    return (
        _lines(spark, folder, "l_returnflag")
        .filter(flag.isin("R", "A"))
        .select(
            F.col("l_orderkey").alias(KEY),
            F.concat(F.lit("s_"), F.col("p_size").cast("string")).alias("evidence_id"),
            F.when(flag == "R", "present").otherwise("absent").alias("state"),
        )
    )


def codes(spark: SparkSession, folder: str) -> DataFrame:
    """``case_id, code``, repeats included."""
    supplier = F.col("l_suppkey")
    detail = F.when(supplier % 3 == 0, F.concat(F.lit("."), (supplier % 10).cast("string"))).otherwise("")
    return (
        _lines(spark, folder, "l_suppkey", "l_linenumber")
        .filter("l_linenumber <= 2")
        .select(
            F.col("l_orderkey").alias(KEY),
            F.concat(
                F.char(65 + F.col("l_partkey") % 26),
                F.lpad((F.col("p_size") * 2 - 1).cast("string"), 2, "0"),
                detail,
            ).alias("code"),
        )
    )


def code_masks(coded: DataFrame) -> DataFrame:
    """The blocks of each case as one long."""
    return coded.groupBy(KEY).agg(F.bit_or(block_mask(F.col("code"))).alias("mask"))


def code_blocks(coded: DataFrame) -> DataFrame:
    """Sorted blocks per case."""
    return code_masks(coded).select(KEY, blocks_of_mask(F.col("mask")).alias("blocks"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """``case_id, expected_condition_icd10_blocks`` of cases with at least one code."""
    return code_masks(codes(spark, folder)).select(KEY, label_of_mask(F.col("mask")).alias(TARGET))


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """The target of every case; a case without codes has the label ``[]``."""
    keys = people(spark, folder).select(KEY)
    masks = keys.join(code_masks(codes(spark, folder)), KEY, "left")
    return masks.select(KEY, label_of_mask(F.col("mask")).alias(TARGET))


def nested_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows with list columns, for the encoder and the classifiers.

    The lists are sets, combined within each task, so a list is at most as long as the
    vocabulary however many lines one case has; the raw lengths are kept as counts.
    """
    state, found = F.col("state"), F.col("evidence_id")
    lists = evidence(spark, folder).groupBy(KEY).agg(
        F.sort_array(F.collect_set(F.when(state == "present", found))).alias("evidence_present"),
        F.sort_array(F.collect_set(F.when(state == "absent", found))).alias("evidence_absent"),
        F.count(F.when(state == "present", 1)).alias(PRESENT_COUNT),
        F.count(F.when(state == "absent", 1)).alias(ABSENT_COUNT),
    )
    empty = F.array().cast("array<string>")
    return (
        with_age(people(spark, folder))
        .join(lists, KEY, "left")
        .withColumns(
            {
                "evidence_present": F.coalesce("evidence_present", empty),
                "evidence_absent": F.coalesce("evidence_absent", empty),
                PRESENT_COUNT: F.coalesce(PRESENT_COUNT, F.lit(0)),
                ABSENT_COUNT: F.coalesce(ABSENT_COUNT, F.lit(0)),
            }
        )
    )
