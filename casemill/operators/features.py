"""Scaling of sex, age and evidence counts, and assembly of the feature vector."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from casemill.operators.evidence import ABSENT_COUNT, PRESENT_COUNT, EvidenceEncoder
from casemill.operators.stages import (
    DefaultParamsReadable,
    DefaultParamsWritable,
    Estimator,
    StatefulModel,
    keyword_only,
    param,
)

CATEGORY_LIMIT = 1000


def ordinal(value: Column, categories: list[str]) -> Column:
    """Position in the sorted categories, -1 for a value not among them."""
    known = F.array(*[F.lit(c) for c in categories]).cast("array<string>")
    return F.coalesce(F.array_position(known, value) - 1, F.lit(-1)).cast("double")


def standardized(value: Column, mean: float, deviation: float) -> Column:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    return (value - F.lit(mean)) / F.lit(deviation or 1.0)


def min_max(value: Column, low: float, high: float, to: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """Linear map of [low, high] to ``to``; a constant column becomes the lower end."""
    return (value - F.lit(low)) * F.lit((to[1] - to[0]) / ((high - low) or 1.0)) + F.lit(to[0])


class _ScalerParams:
    sexCol = param("sexCol", "categorical column", "str")
    ageCol = param("ageCol", "column to standardise", "str")
    countCols = param("countCols", "columns to map to [-1, 1]")

    def _defaults(self) -> None:
        self._setDefault(sexCol="sex", ageCol="age_in_months", countCols=[])

    def output_columns(self) -> list[str]:
        counts = [f"{c}_scaled" for c in self.getOrDefault("countCols")]
        return ["sex_code", "age_scaled", *counts]


class CaseScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the sex categories and, in one aggregate, all moments and ranges."""

    @keyword_only
    def __init__(self, sexCol="sex", ageCol="age_in_months", countCols=None):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CaseScalerModel:
        sex, age = self.getOrDefault("sexCol"), self.getOrDefault("ageCol")
        found = df.select(sex).distinct().limit(CATEGORY_LIMIT + 1).collect()
        if len(found) > CATEGORY_LIMIT:
            raise ValueError(f"{sex} has more than {CATEGORY_LIMIT} categories")
        counts = self.getOrDefault("countCols")
        ranges = [f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(counts) for n, f in (("lo", F.min), ("hi", F.max))]
        row = df.agg(F.avg(age).alias("mean"), F.stddev_pop(age).alias("std"), *ranges).first()
        if row["mean"] is None:
            raise ValueError("no rows to fit on")
        state = {
            "categories": sorted(r[0] for r in found if r[0] is not None),
            "mean": row["mean"],
            "std": row["std"],
            "ranges": [[row[f"lo{i}"], row[f"hi{i}"]] for i in range(len(counts))],
        }
        return self._copyValues(CaseScalerModel(state))


class CaseScalerModel(StatefulModel, _ScalerParams):
    def __init__(self, state: dict | None = None):
        super().__init__()
        self._defaults()
        self.state = state

    def _state(self):
        return self.state, {}

    def _restore(self, small, table) -> None:
        self.state = small

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        columns = {
            "sex_code": ordinal(F.col(self.getOrDefault("sexCol")), s["categories"]),
            "age_scaled": standardized(F.col(self.getOrDefault("ageCol")), s["mean"], s["std"]),
        }
        for c, (low, high) in zip(self.getOrDefault("countCols"), s["ranges"]):
            columns[f"{c}_scaled"] = min_max(F.col(c), low, high)
        return df.withColumns(columns)


def feature_stages(count_evidence: bool, include_absent: bool, count_cols: list[str] | None = None) -> list:
    """Encoder, scaler and assembler. Vector order: sex, age, scaled counts, evidence."""
    encoder = EvidenceEncoder(
        countEvidence=count_evidence,
        includeAbsentEvidence=include_absent,
        countCols=count_cols or [],
    )
    counts = [PRESENT_COUNT, ABSENT_COUNT] if include_absent else [PRESENT_COUNT]
    scaler = CaseScaler(countCols=counts if count_evidence else [])
    assembler = VectorAssembler(
        inputCols=[*scaler.output_columns(), "evidence"], outputCol="features", handleInvalid="error"
    )
    return [encoder, scaler, assembler]
