"""Stored result tables, their text form, and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from casemill.schema import RESULT_SCHEMA


class ResultStore:
    """Result rows of one run as parquet, one partition per model class.

    Rows are appended as they are found, so that a stopped run goes on with the missing
    configurations. ``run_id`` keeps the rows of different runs apart.
    """

    def __init__(self, spark: SparkSession, folder: str, run_id: str):
        self.spark, self.run = spark, f"{folder.rstrip('/')}/run={run_id}"

    def path(self, table: str) -> str:
        return f"{self.run}/{table}"

    def append(self, table: str, rows: DataFrame) -> None:
        if not rows.isEmpty():
            rows.write.mode("append").partitionBy("model_class").parquet(self.path(table))

    def read(self, table: str) -> DataFrame:
        """The stored rows; an empty table if nothing was stored yet."""
        try:
            return self.spark.read.schema(RESULT_SCHEMA).parquet(self.path(table)).select(RESULT_SCHEMA.names)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], RESULT_SCHEMA)

    def write_text(self, table: str, rows: DataFrame) -> bool:
        """The table as CSV with a header; an empty table writes nothing and gives False."""
        if rows.isEmpty():
            return False
        text_form(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{self.path(table)}_csv")
        return True


def text_form(rows: DataFrame) -> DataFrame:
    """Flat columns only: parameter maps as JSON text, nested scores left out."""
    kept = [c for c in rows.columns if c not in ("model_str", "fold_scores", "model_path")]
    return rows.select(*[F.to_json(c).alias(c) if c == "params" else F.col(c) for c in kept])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
