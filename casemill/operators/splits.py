"""Stratified folds, exact hold-out splits and learning-curve prefixes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casemill.operators.ranking import (
    BUCKET,
    default_buckets,
    order_bounds,
    rank_within,
    with_bucket,
)

FOLD = "fold"


def fold_of_rank(rank: Column, rows: Column, before: Column, folds: int) -> Column:
    """Fold of the row number ``rank`` of a class with ``rows`` rows, ``before`` rows ahead of it.

    With all rows sorted by class, position p belongs to fold p mod ``folds``; this fixes how
    many rows of the class every fold gets, and the rows fill the folds in order.
    """

    def multiples_below(end: Column, i: int) -> Column:
        return F.floor((end + folds - 1 - i) / folds)

    fold, filled = F.lit(0), F.lit(0)
    for i in range(folds - 1):
        filled = filled + multiples_below(before + rows, i) - multiples_below(before, i)
        fold = fold + F.when(rank >= filled, 1).otherwise(0)
    return fold.cast("int")


def stratified_folds(
    df: DataFrame,
    key: str,
    label: str,
    folds: int = 5,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``fold``: stratified by ``label``, unshuffled, rows taken in ``key`` order.

    ``df`` is read three times (slice bounds, counts, rows), so it should be a stored or
    persisted table, and so should the result, which all fits share.
    """
    bounds = order_bounds(df, key, buckets or default_buckets(df))
    ranked = rank_within(df, key, label, bounds, out="_rank")
    fold = fold_of_rank(F.col("_rank"), F.col("group_rows"), F.col("group_before"), folds)
    return ranked.withColumn(FOLD, fold).drop("_rank", "group_rows", "group_first", "group_before")


def holdout_split(df: DataFrame, key: str, test_size: float, seed: int = 0) -> DataFrame:
    """Add ``split``; exactly ``ceil(rows * test_size)`` pseudo-random rows are ``test``.

    Rows are ordered by a digest of seed and key. Counts per digest prefix (at most 16**4 rows)
    show which prefix holds the cut, and only the rows of that one are sorted; the result
    itself compares each row with the cut, so it adds no shuffle to ``df``.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    prefix = F.substring(digest, 1, 4)
    counts = {r["p"]: r["n"] for r in df.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}
    wanted, before, cut = math.ceil(sum(counts.values()) * test_size), 0, None
    for p in sorted(counts):
        if before + counts[p] >= wanted:
            cut = p
            break
        before += counts[p]
    if cut is None or wanted == before:
        in_test = F.lit(False) if cut is None else prefix < cut
    else:
        place = F.struct(digest.alias("digest"), F.col(key).alias("key"))
        last = (
            df.filter(prefix == cut)
            .select(place.alias("place"))
            .orderBy("place")
            .limit(wanted - before)
            .agg(F.max("place").alias("place"))
            .first()["place"]
        )
        end = F.lit(last["digest"])
        in_test = (digest < end) | ((digest == end) & (F.col(key) <= F.lit(last["key"])))
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def prefix_cutoffs(
    folded: DataFrame,
    key: str,
    fractions: Sequence[float],
    folds: int = 5,
    buckets: int | None = None,
) -> DataFrame:
    """``fold, fraction, n_rows, cutoff_key``: where each learning-curve prefix ends.

    The training prefix of a fold is every row of another fold whose key is at most
    ``cutoff_key``. All prefixes have ``floor(fraction * rows)`` rows, counted on the training
    rows of the first fold. ``key`` must be unique.
    """
    bounds = order_bounds(folded, key, buckets or default_buckets(folded))
    sliced = with_bucket(folded.select(key, FOLD), key, bounds)
    outside = [F.when(F.col(FOLD) != i, 1).otherwise(0) for i in range(folds)]
    cells = sliced.groupBy(BUCKET).agg(*[F.sum(outside[i]).alias(f"_n{i}") for i in range(folds)])
    # One row per slice.
    earlier = W.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cells = cells.select(
        BUCKET,
        F.sum("_n0").over(whole).alias("_train_rows"),
        *[F.coalesce(F.sum(f"_n{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i in range(folds)],
    )
    running = W.partitionBy(BUCKET).orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    ranked = sliced.select(
        key, FOLD, BUCKET, *[F.sum(outside[i]).over(running).alias(f"_r{i}") for i in range(folds)]
    ).join(cells, BUCKET)
    places = F.array(
        *[
            F.struct(F.lit(i).alias(FOLD), (F.col(f"_o{i}") + F.col(f"_r{i}")).alias("_rank"))
            for i in range(folds)
        ]
    )
    sizes = F.array(
        *[
            F.struct(
                F.lit(float(f)).alias("fraction"),
                F.floor(F.col("_train_rows") * F.lit(float(f))).alias("n_rows"),
            )
            for f in fractions
        ]
    )
    return (
        ranked.withColumns({"_sizes": sizes, "_places": places})
        .select(F.col(key).alias("cutoff_key"), F.col(FOLD).alias("_own"), "_sizes", F.explode("_places").alias("_p"))
        .filter("_p.fold <> _own")
        .select("cutoff_key", "_p.fold", "_p._rank", F.explode("_sizes").alias("_t"))
        .filter("_rank = _t.n_rows")
        .select(FOLD, "_t.fraction", "_t.n_rows", "cutoff_key")
    )
