"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = "*", app: str = "casemill", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CASEMILL_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, visible to every executor.

    It is taken from ``spark.checkpoint.dir``. A local session without that setting gets a
    temporary folder; on a cluster a missing setting is an error, since a folder of one
    machine is lost with that machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="casemill-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs a re-read only."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_through(df: DataFrame, *measures: Column):
    """Write ``df`` as a table in the shared folder and read it back.

    Like a checkpoint, but in one job and with sizes known to the optimizer: for loops. With
    ``measures`` (aggregates with an alias) their values are taken while writing, and the
    result is ``(table, {alias: value})``.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *measures) if measures else df).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[id(table)] = (weakref.ref(table), path)
    return (table, seen.get) if measures else table


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder with the tables of this application; it goes when the session ends in order."""
    folder = f"{shared_folder(spark)}/casemill-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(clean_up, spark, folder)
    return folder


_folders: set[str] = set()


def clean_up(spark: SparkSession, folder: str | None = None) -> None:
    """Delete all tables that ``write_through`` made for this session. Call it before ``spark.stop()``."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(folder or run_folder(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_written: dict[int, tuple[weakref.ref, str]] = {}


def discard(table: DataFrame) -> None:
    """Delete a table of ``write_through`` that nothing reads any more; other tables are kept."""
    reference, path = _written.pop(id(table), (None, None))
    if path is None or reference() is not table:
        return
    jvm = table.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
