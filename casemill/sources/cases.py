"""Reading raw cases and chapter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casemill.functions.scalar import block_end, block_start
from casemill.schema import CASE_SCHEMA, ICD10_BLOCKS


def read_cases(spark: SparkSession, path: str, layout: str = "json") -> DataFrame:
    """Scan raw cases with the declared nested schema (no inference pass).

    ``json`` is one top-level array per file, which Spark cannot split: use ``jsonl`` (one
    case per line) or ``parquet`` for large inputs.
    """
    reader = spark.read.schema(CASE_SCHEMA)
    if layout == "json":
        return reader.option("multiLine", True).option("encoding", "UTF-8").json(path)
    if layout == "jsonl":
        return reader.json(path)
    if layout == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown layout {layout!r}; use json, jsonl or parquet")


def require_rows(raw: DataFrame) -> DataFrame:
    """Reject an empty input; reads at most one row."""
    if raw.isEmpty():
        raise ValueError("no cases were loaded")
    return raw


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """A ``block,title`` file with header, as ``pos, block, lo, hi, title``.

    ``pos`` is the line order within a file; the table is expected in a single file.
    """
    table = (
        spark.read.schema("block string, title string")
        .option("header", True)
        .option("multiLine", True)
        .csv(path)
        .withColumn("pos", F.monotonically_increasing_id())
    )
    return _with_bounds(table).select("pos", "block", "lo", "hi", "title")


def builtin_chapters(spark: SparkSession) -> DataFrame:
    table = spark.createDataFrame(list(enumerate(ICD10_BLOCKS)), "pos long, block string")
    return _with_bounds(table)


def _with_bounds(table: DataFrame) -> DataFrame:
    return table.withColumns({"lo": block_start(F.col("block")), "hi": block_end(F.col("block"))})
