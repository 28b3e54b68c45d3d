"""Column profiles, value counts and functional dependencies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def count_rare(df: DataFrame, column: str, threshold: int = 5) -> DataFrame:
    """How many values occur in fewer than ``threshold`` rows."""
    return value_counts(df, column).filter(F.col("n") < threshold).agg(F.count("*").alias("n_rare"))


def derivable(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Which columns are a function of ``key``: ``key, column, derivable``.

    A column has at most one distinct value per group if and only if its smallest and largest
    values there are equal. Minimum and maximum combine within each task, so all columns are
    tested in one pass with bounded state, where distinct counts would multiply the rows.
    """
    bounds = [f(c).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    groups = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*bounds)
    broken = groups.agg(
        *[
            F.coalesce(F.max(F.col(f"_lo{i}") != F.col(f"_hi{i}")), F.lit(False)).alias(f"_b{i}")
            for i in range(len(columns))
        ]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), (~F.col(f"_b{i}")).alias("derivable")) for i, c in enumerate(columns)]
    )
    return broken.select(F.lit(key).alias("key"), F.explode(rows).alias("_r")).select("key", "_r.*")


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def _as_text(field: T.StructField):
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(field.name)
    return F.col(field.name).cast("string")


def frequencies(df: DataFrame) -> DataFrame:
    """``column, value, n`` for every column: one pass and one shuffle for all of them.

    Each input row becomes one row per column inside the task and is combined there, so a
    frequent value leaves a task once.
    """
    cells = F.array(
        *[F.struct(F.lit(f.name).alias("column"), _as_text(f).alias("value")) for f in df.schema.fields]
    )
    return (
        df.select(F.explode(cells).alias("_c"))
        .select("_c.column", "_c.value")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def profile(df: DataFrame, minimal: bool = False) -> DataFrame:
    """One row per column: rows, missing, distinct, distinct share, top value and numeric moments.

    Unless ``minimal``, approximate quartiles are added (fixed-size sketches).
    """
    counted = frequencies(df)
    rows = F.sum("n")
    shown = F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("less"), "value"))
    base = counted.groupBy("column").agg(
        rows.alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        (F.count("value") / rows).alias("distinct_share"),
        # Of equally frequent values the smallest is shown.
        F.min(shown).alias("_top"),
    )
    top_n = F.when(F.col("_top").isNotNull(), -F.col("_top.less")).alias("top_n")
    base = base.select("column", "n_rows", "n_missing", "n_distinct", "distinct_share", top_n, F.col("_top.value").alias("top_value"))

    numbers = [f for f in df.schema.fields if _is_number(f)]
    if not numbers:
        return base
    names = ["min", "max", "mean", "std"] + ([] if minimal else ["q25", "q50", "q75"])
    parts = []
    for i, f in enumerate(numbers):
        c = F.col(f.name).cast("double")
        stats = [F.min(c), F.max(c), F.avg(c), F.stddev_samp(c)]
        if not minimal:
            stats += [F.percentile_approx(c, q) for q in (0.25, 0.5, 0.75)]
        parts += [s.alias(f"_{n}{i}") for n, s in zip(names, stats)]
    stats_rows = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), *[F.col(f"_{n}{i}").alias(n) for n in names])
            for i, f in enumerate(numbers)
        ]
    )
    stats = df.agg(*parts).select(F.explode(stats_rows).alias("_s")).select("_s.*")
    return base.join(stats, "column", "left")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, and the distinct rows that are repeated."""
    keys = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema.fields]
    copies = df.select(*keys).groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_duplicate_rows"),
        F.count(F.when(F.col("_copies") > 1, 1)).alias("n_repeated"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _is_number(f)]


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, all from one aggregate."""
    names = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = df.agg(*[F.corr(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_r{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return found.select(F.explode(rows).alias("_r")).select("_r.*")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width counts ``column, bin, n``. The limits of all columns are found first, as one row."""
    sides = [f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    limits = df.agg(*sides).first()
    cells = []
    for i, c in enumerate(columns):
        lo, hi = limits[f"lo{i}"], limits[f"hi{i}"]
        x = F.col(c).cast("double")
        if lo is None or lo == hi:
            place = F.lit(0)
        else:
            place = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1))
        cells.append(F.struct(F.lit(c).alias("column"), F.when(x.isNotNull(), place).cast("int").alias("bin")))
    return (
        df.select(F.explode(F.array(*cells)).alias("_c"))
        .select("_c.column", "_c.bin")
        .filter("bin is not null")
        .groupBy("column", "bin")
        .agg(F.count("*").alias("n"))
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
