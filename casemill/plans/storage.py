"""Registered queries of the readers and sinks: what is written is read back and used."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from casemill.functions.scalar import list_label
from casemill.operators.range_lookup import range_lookup
from casemill.operators.registry import NamedClassifier
from casemill.plans import evaluate as ev, relational, table_cases as tc, tuning
from casemill.plans.load import case_table
from casemill.plans.learning import vectors
from casemill.schema import ICD10_BLOCKS, KEY, TARGET
from casemill.session import run_folder
from casemill.sources.cases import read_cases, read_chapters
from casemill.sources.results import ResultStore, load_model, save_model

#: Cases in one array file, which a single task has to read.
ARRAY_ROWS = 2_000


def _new_path(spark: SparkSession) -> str:
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def _flat(raw: DataFrame) -> DataFrame:
    lists = [list_label(F.col(c)).alias(c) for c in ("evidence_present", "evidence_absent")]
    return case_table(raw).select(KEY, "sex", "age_in_months", *lists, TARGET)


def json_lines_cases(spark, sf):
    """Cases written as JSON lines and scanned with the declared schema."""
    path = _new_path(spark)
    relational.raw_records(spark, sf).write.text(path)
    return _flat(read_cases(spark, path, "jsonl"))


def json_array_cases(spark, sf):
    """Cases written as files of one JSON array each, which Spark reads whole."""
    path = _new_path(spark)
    records = relational.raw_records(spark, sf)
    files = max(1, tc.people(spark, sf).count() // ARRAY_ROWS)
    arrays = records.groupBy(F.pmod(F.xxhash64("value"), F.lit(files)).alias("file")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value")
    )
    arrays.write.partitionBy("file").text(path)
    return _flat(read_cases(spark, f"{path}/*", "json"))


def parquet_cases(spark, sf):
    """Cases kept as nested parquet: the scan reads the needed fields only."""
    path = _new_path(spark)
    lines = _new_path(spark)
    relational.raw_records(spark, sf).write.text(lines)
    read_cases(spark, lines, "jsonl").write.parquet(path)
    return _flat(read_cases(spark, path, "parquet"))


def chapter_file_blocks(spark, sf):
    """Codes looked up in a chapter table that comes from a CSV file."""
    path = _new_path(spark)
    titles = [(b, f'Chapter "{i}", codes {b}') for i, b in enumerate(ICD10_BLOCKS)]
    spark.createDataFrame(titles, "block string, title string").coalesce(1).write.option("header", True).option(
        "escape", '"'
    ).csv(path)
    return range_lookup(tc.codes(spark, sf).distinct(), "code", read_chapters(spark, path).drop("title"))


def results_as_text(spark, sf):
    """The grid of the vectors, stored, written as CSV with a header, and read back."""
    _, _, grid = tuning._vector_search(spark, sf)
    store = ResultStore(spark, _new_path(spark), "text")
    store.append("grid_search", grid)
    store.write_text("grid_search", store.read("grid_search"))
    schema = "seq long, model_class string, dim_reduction_algorithm string, n_dimensions int, count_evidence boolean, include_absent_evidence boolean, params string, mean_train_score double, mean_test_score double"
    back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{store.path('grid_search')}_csv")
    return back.select(
        "seq", "model_class", F.get_json_object("params", "$.n_neighbors").cast("int").alias("n_neighbors"),
        F.round("mean_train_score", 6).alias("mean_train_score"), F.round("mean_test_score", 6).alias("mean_test_score"),
    )


def resumed_sweep(spark, sf):
    """A sweep that stopped after its first candidate, under other numbers, and went on in a second run."""
    judge = tuning.vector_judge(spark, sf)
    wanted = ev.sweep_candidates(**tuning.VECTOR_SWEEP)
    store = ResultStore(spark, _new_path(spark), "resumed")
    judge.sweep([wanted[-1]._replace(seq=0)], store)
    return tuning._rounded(judge.sweep(wanted, ResultStore(spark, store.run.rsplit("/run=", 1)[0], "resumed")))


def saved_model_predictions(spark, sf):
    """Predictions of a saved and reloaded classifier for the rows that it was fitted on."""
    rows, path = vectors(spark, sf), _new_path(spark)
    save_model(ev.Pipeline(stages=[NamedClassifier(name="KNeighborsClassifier", params_={"n_neighbors": 5})]).fit(rows), path)
    return load_model(path).transform(rows).select(
        F.col(KEY).alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")
    )


QUERIES = {
    f.__name__: f
    for f in (
        json_lines_cases,
        json_array_cases,
        parquet_cases,
        chapter_file_blocks,
        results_as_text,
        resumed_sweep,
        saved_model_predictions,
    )
}
