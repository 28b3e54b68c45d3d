"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: ASCII capital and small letters, for lower-casing that leaves other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word separators of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses the same ones.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without the columns of these names, in either case: results replace them."""
    gone = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in gone])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def add_columns(
    df: DataFrame, fields: str, make: Callable[[], Callable[[pa.RecordBatch], list]], drop: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` with columns computed from Arrow batches, in place; no shuffle.

    ``make`` is called once per task and returns a function from a batch to one list per field of
    ``fields`` (a DDL string). Columns of ``drop`` and those with names in ``fields`` are left out.
    """
    new = T._parse_datatype_string(fields)
    gone = {n.lower() for n in [*drop, *new.names]}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = T.StructType([*kept, *new.fields])
    names = [f.name for f in kept]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = [pa.array(v, t) for v, t in zip(work(batch), types, strict=True)]
            old = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*old, *made], names=[*names, *new.names])

    return df.mapInArrow(run, schema)


def make_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[list]]]) -> DataFrame:
    """Rows made from Arrow batches: ``make()`` returns a function from a batch to an iterator of column lists."""
    new = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for columns in work(batch):
                arrays = [pa.array(v, t) for v, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=new.names)

    return df.mapInArrow(run, new)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``limit`` bytes in one text column, or of one row."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for at, size in enumerate(sizes.tolist()):
        if held + size > limit and at > start:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, as its periodic cleaner does every half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once, also where the body uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def text_key(text: Column) -> Column:
    """With the id, the identity of a row: rows that agree in both are alike in all results."""
    return F.xxhash64(text)


class Ragged:
    """Rows of numbers with different lengths."""

    def __init__(self):
        self.data, self.starts, self.used = np.zeros(1024, np.uint32), np.zeros(1024, np.int64), 0
        self.count = 0

    def extend(self, data: np.ndarray, ends) -> None:
        """Add rows that end at ``ends`` of ``data``."""
        need = self.used + len(data)
        if need > len(self.data):
            self.data = np.resize(self.data, 2 * need)
        self.data[self.used : need] = data
        last = self.count + len(ends)
        if last >= len(self.starts):
            self.starts = np.resize(self.starts, 2 * last + 1)
        self.starts[self.count + 1 : last + 1] = self.used + np.asarray(ends, np.int64)
        self.used, self.count = need, last

    def rows(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows with these numbers one behind the other, and their lengths."""
        starts = self.starts
        sizes = starts[numbers + 1] - starts[numbers]
        ends = np.cumsum(sizes)
        places = np.repeat(starts[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.data[places], sizes
