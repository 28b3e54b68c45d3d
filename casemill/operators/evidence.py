"""Ternary evidence encoding: 1 present, -1 absent, 0 (no row) otherwise.

Two forms exist. Nested cases hold two id lists in each row, so encoding is a projection.
Evidence as a long table ``(case_id, evidence_id, state)`` is encoded by an aggregate with
map-side combine, which never gathers the rows of one case in a list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casemill.functions.scalar import list_length
from casemill.operators.stages import (
    DefaultParamsReadable,
    DefaultParamsWritable,
    Estimator,
    StatefulModel,
    keyword_only,
    param,
)
from casemill.schema import KEY
from casemill.session import write_through

PRESENT_COUNT = "present_evidence_count"
ABSENT_COUNT = "absent_evidence_count"

# Above this many ids a vector per row is the wrong form: use the long table.
VECTOR_LIMIT = 200_000


# --- long tables -------------------------------------------------------------------------


def distinct_ids(evidence: DataFrame, include_absent: bool = True) -> DataFrame:
    """The ids of a long evidence table; a frequent id leaves each task once."""
    states = ["present", "absent"] if include_absent else ["present"]
    return evidence.filter(F.col("state").isin(states)).select("evidence_id").distinct()


def vocabulary(evidence: DataFrame, include_absent: bool = True) -> DataFrame:
    """Sorted distinct ids as ``evidence_id, idx``, with ``idx`` the position in the sorted list.

    The ids are sorted by range and written once. A generated row id holds the slice and the
    place in it; adding the sizes of the earlier slices gives the position, so no task holds
    all ids.
    """
    placed = write_through(
        distinct_ids(evidence, include_absent)
        .orderBy("evidence_id")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # The upper bits number the slice, the lower 33 bits the row in it.
    slices = placed.groupBy(F.shiftright("_at", 33).alias("_slice")).agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # One row per slice.
    starts = slices.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_slice", F.shiftright("_at", 33))
        .join(F.broadcast(starts), "_slice")
        .select(
            "evidence_id",
            (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("idx"),
        )
    )


def encode_long(
    evidence: DataFrame,
    known: DataFrame | None = None,
    include_absent: bool = True,
    handle_unknown: str = "ignore",
) -> DataFrame:
    """``case_id, evidence_id, value`` of a long evidence table; absent wins over present.

    ``known`` restricts the result to a fitted vocabulary. It has one row per id, so Spark
    broadcasts it while it is small and splits a frequent id's partition otherwise.
    """
    check_handle_unknown(handle_unknown)
    states = ["present", "absent"] if include_absent else ["present"]
    value = F.when(F.col("state") == "absent", F.lit(-1)).otherwise(F.lit(1))
    encoded = (
        evidence.filter(F.col("state").isin(states))
        .groupBy(KEY, "evidence_id")
        .agg(F.min(value).alias("value"))
    )
    if known is None:
        return encoded
    ids = known.select("evidence_id")
    if handle_unknown == "ignore":
        return encoded.join(ids, "evidence_id", "left_semi").select(KEY, "evidence_id", "value")
    marked = encoded.join(ids.withColumn("_known", F.lit(True)), "evidence_id", "left")
    failure = F.raise_error(F.concat(F.lit("not in the fitted vocabulary: "), F.col("evidence_id")))
    value = F.when(F.col("_known").isNull(), failure.cast("int")).otherwise(F.col("value"))
    return marked.select(KEY, "evidence_id", value.alias("value"))


def counts_long(evidence: DataFrame) -> DataFrame:
    """Present and absent rows per case, duplicates included."""
    return evidence.groupBy(KEY).agg(
        F.count(F.when(F.col("state") == "present", 1)).alias(PRESENT_COUNT),
        F.count(F.when(F.col("state") == "absent", 1)).alias(ABSENT_COUNT),
    )


# --- nested lists ------------------------------------------------------------------------


def explode_lists(table: DataFrame, present: str = "evidence_present", absent: str = "evidence_absent"):
    """The lists of nested cases as a long evidence table."""
    parts = [
        table.select(KEY, F.explode(c).alias("evidence_id"), F.lit(state).alias("state"))
        for c, state in ((present, "present"), (absent, "absent"))
    ]
    return parts[0].unionByName(parts[1])


def ternary_entries(present: Column, absent: Column | None) -> Column:
    """The non-zero entries of one row, as an array of ``(evidence_id, value)``."""

    def entries(ids: Column, value: int) -> Column:
        pair = lambda x: F.struct(x.alias("evidence_id"), F.lit(value).alias("value"))
        return F.transform(ids, pair)

    none = F.array().cast("array<string>")
    present = F.coalesce(present, none)
    if absent is None:
        return entries(F.array_distinct(present), 1)
    absent = F.coalesce(absent, none)
    return F.concat(
        entries(F.array_distinct(absent), -1), entries(F.array_except(present, absent), 1)
    )


def check_handle_unknown(value: str) -> None:
    if value not in ("ignore", "error"):
        raise ValueError(f"handle_unknown must be 'ignore' or 'error', not {value!r}")


def _flat(ids: pa.Array, ordered: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row number, vocabulary position (-1 unknown) and id of every list element."""
    rows = pc.list_parent_indices(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(ids)
    found = pc.fill_null(pc.index_in(values, value_set=ordered), -1)
    return rows, found.to_numpy(zero_copy_only=False).astype(np.int64), values


def _vector_encoder(ids: list[str], strict: bool):
    """A vectorised encoder of two list columns into sparse vectors."""
    from pyspark.sql.functions import arrow_udf

    def encode(present: pa.Array, absent: pa.Array) -> pa.Array:
        ordered = pa.array(ids, pa.string())
        width, n = len(ids), len(present)
        cells, signs = [], []
        for lists, sign in ((absent, -1.0), (present, 1.0)):
            rows, found, values = _flat(lists, ordered)
            if strict and (found < 0).any():
                raise ValueError(f"not in the fitted vocabulary: {values[int(np.argmax(found < 0))].as_py()}")
            known = found >= 0
            cells.append(rows[known] * width + found[known])
            signs.append(np.full(int(known.sum()), sign))
        # The first occurrence of a cell is kept, and absent comes first.
        unique, first = np.unique(np.concatenate(cells), return_index=True)
        value = np.concatenate(signs)[first]
        starts = np.searchsorted(unique, np.arange(n + 1) * width).astype(np.int32)
        columns = (unique % max(width, 1)).astype(np.int32)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(n, np.int8)),
                pa.array(np.full(n, width, np.int32)),
                pa.ListArray.from_arrays(pa.array(starts), pa.array(columns)),
                pa.ListArray.from_arrays(pa.array(starts), pa.array(value)),
            ],
            ["type", "size", "indices", "values"],
        )

    encode.__annotations__ = {"present": pa.Array, "absent": pa.Array, "return": pa.Array}
    return arrow_udf(encode, VectorUDT())


class _EvidenceParams:
    handleUnknown = param("handleUnknown", "'ignore' or 'error' for ids not seen in fit", "str")
    countEvidence = param("countEvidence", "add columns with the lengths of the lists", "bool")
    includeAbsentEvidence = param("includeAbsentEvidence", "encode absent evidence too", "bool")
    presentCol = param("presentCol", "list of present ids", "str")
    absentCol = param("absentCol", "list of absent ids", "str")
    outputCol = param("outputCol", "sparse ternary vector", "str")
    countCols = param("countCols", "existing columns with raw list lengths, if lists are deduplicated")

    def _defaults(self) -> None:
        self._setDefault(
            handleUnknown="ignore",
            countEvidence=False,
            includeAbsentEvidence=True,
            presentCol="evidence_present",
            absentCol="evidence_absent",
            outputCol="evidence",
            countCols=[],
        )

    def get(self, name: str):
        return self.getOrDefault(name)

    def count_names(self) -> list[str]:
        if not self.get("countEvidence"):
            return []
        return [PRESENT_COUNT, ABSENT_COUNT] if self.get("includeAbsentEvidence") else [PRESENT_COUNT]


class EvidenceEncoder(Estimator, _EvidenceParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the sorted evidence vocabulary of the two list columns."""

    @keyword_only
    def __init__(
        self,
        handleUnknown="ignore",
        countEvidence=False,
        includeAbsentEvidence=True,
        presentCol="evidence_present",
        absentCol="evidence_absent",
        outputCol="evidence",
        countCols=None,
    ):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> EvidenceEncoderModel:
        check_handle_unknown(self.get("handleUnknown"))
        lists = F.coalesce(F.col(self.get("presentCol")), F.array().cast("array<string>"))
        if self.get("includeAbsentEvidence"):
            absent = F.coalesce(F.col(self.get("absentCol")), F.array().cast("array<string>"))
            lists = F.concat(lists, absent)
        ids = df.select(F.explode(F.array_distinct(lists)).alias("id")).filter("id IS NOT NULL").distinct()
        rows = ids.limit(VECTOR_LIMIT + 1).collect()
        if len(rows) > VECTOR_LIMIT:
            raise ValueError(
                f"more than {VECTOR_LIMIT} evidence ids: encode with the long form (encode_long)"
            )
        model = EvidenceEncoderModel(sorted(r["id"] for r in rows))
        return self._copyValues(model)


class EvidenceEncoderModel(StatefulModel, _EvidenceParams):
    def __init__(self, ids: list[str] | None = None):
        super().__init__()
        self._defaults()
        self.ids = ids

    def _state(self):
        return self.ids, {}

    def _restore(self, small, table) -> None:
        self.ids = small

    def _lists(self) -> tuple[Column, Column]:
        none = F.array().cast("array<string>")
        present = F.coalesce(F.col(self.get("presentCol")), none)
        if not self.get("includeAbsentEvidence"):
            return present, none
        return present, F.coalesce(F.col(self.get("absentCol")), none)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.ids is None:
            raise RuntimeError("fit the encoder before transforming")
        encode = _vector_encoder(self.ids, self.get("handleUnknown") == "error")
        present, absent = self._lists()
        out = df.withColumn(self.get("outputCol"), encode(present, absent))
        given = self.get("countCols") or []
        sources = (self.get("presentCol"), self.get("absentCol"))
        for i, name in enumerate(self.count_names()):
            value = F.col(given[i]) if given else list_length(F.col(sources[i]))
            out = out.withColumn(name, value.cast("int"))
        return out

    def transform_long(self, df: DataFrame) -> DataFrame:
        """``case_id, evidence_id, value`` of the encoded lists, without any shuffle."""
        present, absent = self._lists()
        entries = ternary_entries(present, absent)
        long = df.select(KEY, F.explode(entries).alias("_e")).select(KEY, "_e.*")
        known = df.sparkSession.createDataFrame([(i,) for i in self.ids], "evidence_id string")
        marked = long.join(F.broadcast(known.withColumn("_known", F.lit(True))), "evidence_id", "left")
        if self.get("handleUnknown") == "error":
            failure = F.raise_error(F.concat(F.lit("not in the fitted vocabulary: "), F.col("evidence_id")))
            value = F.when(F.col("_known").isNull(), failure.cast("int")).otherwise(F.col("value"))
            return marked.select(KEY, "evidence_id", value.alias("value"))
        return marked.filter("_known").select(KEY, "evidence_id", "value")
