"""Vector columns as numpy blocks inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf


def as_block(lists: pa.Array) -> np.ndarray:
    """A list column with equal lengths as a two-dimensional array."""
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def as_lists(block: np.ndarray) -> pa.Array:
    rows, width = block.shape
    starts = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(starts, pa.array(np.ascontiguousarray(block).ravel()))


def block_map(features: Column, f: Callable[[np.ndarray], np.ndarray], name: str, width: int) -> Column:
    """Apply ``f: (rows, d) -> (rows, width)`` to a vector column, batch by batch.

    The result is called ``name`` and carries its width, so that later stages need no job for it.
    """

    def run(lists: pa.Array) -> pa.Array:
        if len(lists) == 0:
            return pa.array([], pa.list_(pa.float64()))
        return as_lists(f(as_block(lists)))

    mapped = array_to_vector(arrow_udf(run, "array<double>")(vector_to_array(features)))
    return mapped.alias(name, metadata={"ml_attr": {"num_attrs": width}})


def block_score(features: Column, f: Callable[[np.ndarray], np.ndarray]) -> Column:
    """Apply ``f: (rows, d) -> (rows,)`` to a vector column, batch by batch."""

    def run(lists: pa.Array) -> pa.Array:
        if len(lists) == 0:
            return pa.array([], pa.float64())
        return pa.array(np.asarray(f(as_block(lists)), dtype=np.float64))

    return arrow_udf(run, "double")(vector_to_array(features))


def width_of(df: DataFrame, features: str) -> int:
    """Length of the vectors: from the column's metadata, else from one row."""
    size = df.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    if size:
        return int(size)
    row = df.select(F.size(vector_to_array(features)).alias("d")).first()
    if row is None:
        raise ValueError("no rows to fit on")
    return row["d"]


# A d x d matrix of doubles is held on the driver: 8 * d^2 bytes, at most about 3 GB.
WIDTH_LIMIT = 20_000


def check_width(d: int) -> None:
    if d > WIDTH_LIMIT:
        raise ValueError(f"{d} features exceed the {WIDTH_LIMIT} a d x d driver step allows")


# Numbers in one packed block (4 MB).
BLOCK_NUMBERS = 500_000


def packed(df: DataFrame, features: str, label: Column, order: Column | None = None) -> DataFrame:
    """Rows packed into blocks ``x array<double>, y array<int>``, for repeated passes.

    Packing stays within a partition; a block holds at most ``BLOCK_NUMBERS`` numbers. With
    ``order``, rows are packed in that order within the partition.
    """
    rows = df.select(vector_to_array(features).alias("x"), label.cast("int").alias("y"), *([order.alias("_o")] if order is not None else []))
    if order is not None:
        rows = rows.sortWithinPartitions("_o").select("x", "y")

    def pack(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            width = len(batch.column(0)[0])
            step = max(1, BLOCK_NUMBERS // max(width, 1))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x, y = pc.list_flatten(part.column(0)), part.column(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x),
                        pa.ListArray.from_arrays(pa.array([0, len(y)], pa.int32()), y),
                    ],
                    ["x", "y"],
                )

    return rows.mapInArrow(pack, "x array<double>, y array<int>")


def blocks_of(batches):
    """``(x, y)`` arrays of the packed blocks in Arrow batches."""
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1)):
            labels = y.values.to_numpy(zero_copy_only=False)
            yield x.values.to_numpy(zero_copy_only=False).reshape(len(labels), -1), labels


# Numbers in one row of a partial sum (512 kB), and how many partial sums there are after the first round of adding.
CHUNK, SLOTS = 65_536, 32
# Sums of more numbers are added up in Spark to the end.
DRIVER_NUMBERS = 1_000_000
# Vectors of so few numbers together are added on the driver (128 kB), and of so many in one task (128 MB).
FEW_NUMBERS, TASK_NUMBERS = 16_384, 16_000_000


def summed(
    blocks: DataFrame, partial: Callable, size: int, partitions: int | None = None, read: Callable = blocks_of,
    unit: int | None = None, finish: Callable | None = None,
) -> np.ndarray:
    """Sum over all partitions of ``partial(blocks) -> vector`` of a fixed ``size``; ``read`` makes the blocks of Arrow batches.

    Each partition gives its vector as a few rows of packed numbers. Vectors of the same slot are added in one task, so the
    rows that are shuffled depend on the partitions and not on what is in the vector, no task sees more than a share of
    them, and the driver receives at most ``SLOTS`` vectors. Loops that know their number of ``partitions`` spare the shuffle
    while all vectors together are small, and otherwise have a single vector sent to the driver. With ``finish`` only
    ``finish(unit numbers) -> some numbers`` of each ``unit`` of the sum is sent; the result has a row for each.
    """
    schema = "slot int, start long, value binary"
    one = finish is not None or partitions is not None
    chunk = CHUNK if unit is None else unit
    single = one and partitions is not None and partitions * min(size, chunk) <= TASK_NUMBERS

    def run(batches):
        vector = partial(read(batches))
        if vector is not None:
            slot = 0 if single else TaskContext.get().partitionId() % SLOTS
            for start in range(0, len(vector), chunk):
                part = np.ascontiguousarray(vector[start : start + chunk], dtype=np.float64).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot], pa.int32()), pa.array([start], pa.int64()), pa.array([part], pa.binary())], ["slot", "start", "value"]
                )

    def adding(ending=None):
        def add(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py()) for v in rows["value"])
            total = total if ending is None else np.asarray(ending(total), dtype=np.float64)
            return pa.table([rows["slot"][:1], rows["start"][:1], pa.array([total.tobytes()], pa.binary())], ["slot", "start", "value"])

        return add

    parts = blocks.mapInArrow(run, schema)
    few = finish is None and partitions is not None and partitions * size <= FEW_NUMBERS
    twice = not single and (one or size > DRIVER_NUMBERS)
    if not few:
        parts = parts.groupBy("slot", "start").applyInArrow(adding(None if twice else finish), schema)
        if twice:
            parts = parts.withColumn("slot", F.lit(0)).groupBy("slot", "start").applyInArrow(adding(finish), schema)
    rows = parts.toArrow().to_pylist()
    if finish is not None:
        held = {row["start"]: np.frombuffer(row["value"]) for row in rows}
        nothing = None if len(held) == -(-size // chunk) else np.asarray(finish(np.zeros(chunk)), dtype=np.float64)
        return np.array([held.get(start, nothing) for start in range(0, size, chunk)])
    total = np.zeros(size)
    for row in rows:
        value = np.frombuffer(row["value"])
        total[row["start"] : row["start"] + len(value)] += value
    return total


def vector_entries(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, place, value`` of the non-zero entries; a sparse vector is never made dense."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            values = vectors.field("values")
            lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
            flat = values.flatten().to_numpy(zero_copy_only=False)
            places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            sparse = np.repeat(vectors.field("type").to_numpy(zero_copy_only=False) == 0, lengths)
            places[sparse] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(lengths)), lengths)
            kept = flat != 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[kept])), pa.array(places[kept].astype(np.int32)), pa.array(flat[kept])],
                names=[key, "place", "value"],
            )

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, place int, value double")
