"""Exact ranks without a window over an unbounded group, and best rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casemill.functions.scalar import null_if_nan

BUCKET = "_bucket"


def order_bounds(keys: DataFrame, order: str, buckets: int) -> list[float]:
    """Inner bounds cutting a numeric key into ``buckets`` slices of about equal row count."""
    if buckets < 2:
        return []
    cuts = [i / buckets for i in range(1, buckets)]
    found = keys.select(F.col(order).cast("double")).approxQuantile(order, cuts, 0.25 / buckets)
    return sorted(set(found))


def default_buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_bucket(df: DataFrame, order: str, bounds: Sequence[float]) -> DataFrame:
    """Number the slice of each row; the same key always falls in the same slice, a missing one in the first."""
    if not bounds:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    sliced = Bucketizer(splits=splits, inputCol="_order", outputCol="_slice").transform(
        df.withColumn("_order", F.col(order).cast("double"))
    )
    return sliced.withColumn(BUCKET, F.coalesce(F.col("_slice").cast("int"), F.lit(0))).drop("_order", "_slice")


def rank_within(df: DataFrame, order: str, by: str, bounds: Sequence[float], out: str = "rank"):
    """``df`` with the 0-based rank of each row among those of equal ``by``.

    Rows are counted per group and slice first; a row's rank is the count of the earlier
    slices plus its position in its own slice. One group with a third of all rows is thus
    sorted in as many tasks as there are slices. Also adds the group's size (``group_rows``),
    first key (``group_first``) and the count of rows in earlier groups, by first key
    (``group_before``). ``order`` must be unique.
    """
    sliced = with_bucket(df, order, bounds)
    cells = sliced.groupBy(by, BUCKET).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    in_group = W.partitionBy(by)
    cells = cells.select(
        by,
        BUCKET,
        F.coalesce(
            F.sum("_n").over(in_group.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
        F.sum("_n").over(in_group).alias("group_rows"),
        F.min("_first").over(in_group).alias("group_first"),
    )
    # One row per group, so this window without partitions is as small as the class table.
    earlier = W.orderBy("group_first").rowsBetween(W.unboundedPreceding, -1)
    groups = (
        cells.groupBy(by)
        .agg(F.first("group_rows").alias("_rows"), F.first("group_first").alias("_from"))
        .withColumnsRenamed({"_rows": "group_rows", "_from": "group_first"})
        .select(by, F.coalesce(F.sum("group_rows").over(earlier), F.lit(0)).alias("group_before"))
    )
    cells = cells.join(groups, by)
    position = F.row_number().over(W.partitionBy(by, BUCKET).orderBy(order)) - 1
    return (
        sliced.withColumn("_position", position)
        .join(cells, [by, BUCKET])
        .withColumn(out, F.col("_offset") + F.col("_position"))
        .drop("_position", "_offset", BUCKET)
    )


def best_per_group(
    df: DataFrame, group: str | None, score: str, seq: str = "seq", keep: Sequence[str] | None = None
) -> DataFrame:
    """The row with the highest score of each group (or of all), the first by ``seq`` on ties.

    An aggregate, not a window: each task reduces its rows to one per group before the
    shuffle. Null and NaN scores rank last.
    """
    kept = [c for c in (keep or df.columns) if c != group]
    clean = df.withColumn(score, null_if_nan(F.col(score)))
    rank = F.struct(F.col(score), -F.col(seq))
    picked = F.max_by(F.struct(*kept), rank).alias("_best")
    best = (clean.groupBy(group) if group else clean.groupBy()).agg(picked)
    if group is None:
        return best.filter("_best is not null").select("_best.*")
    return best.select(group, "_best.*")


def by_score(df: DataFrame, score: str, seq: str = "seq") -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(seq))


def overlay(
    base: DataFrame, update: DataFrame, key: str, columns: Sequence[str], extra: Sequence[str] = ()
) -> DataFrame:
    """Left join; a non-null new value replaces the old one, ``extra`` columns are added."""
    new = update.select(
        F.col(key).alias("_key"),
        *[F.col(c).alias(f"_new_{c}") for c in columns],
        *extra,
    )
    joined = base.join(new, base[key] == F.col("_key"), "left").drop("_key")
    values = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}
    return joined.withColumns(values).drop(*[f"_new_{c}" for c in columns])


def mean_and_std(df: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """Mean and sample deviation (0 for a single row) per value of ``by``; null keys drop out."""
    parts: list[Column] = []
    for v in values:
        parts.append(F.avg(v).alias(f"{v}_mean"))
        parts.append(F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_std"))
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(*parts)
