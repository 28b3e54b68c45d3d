"""SimHash near-duplicates by pigeonring filtering.

The 64 bits are cut into ``distance + 1`` segments in a ring. If two fingerprints differ in at most ``distance``
bits, then some chain of segments has, for every length l, at most ``l * distance / (distance + 1)`` differences in
its first l segments: none in the first, one in the first two, and so on. So candidates share the first segment of
a chain and its second one up to a bit; the budgets of the longer prefixes prune them before all bits are compared.

A bucket of very many fingerprints is not paired up. There, two fingerprints are linked through the points half way
between them, which takes a number of rows that is linear in the size of the bucket and gives the same components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from casemill.llm.common import add_columns, quoted, text_key, text_of
from casemill.llm.components import components
from casemill.session import write_through

BITS, SEED, SHINGLE, DISTANCE = 64, 42, 4, 4
#: Buckets with more fingerprints are linked through half-way points: about as many rows as pairs at this size.
DENSE_FROM = 1_500
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed number. Bits are set if in over half of the hashes; without words it is zero."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``print`` (signed 64-bit) in place of the text; a null text is empty. No shuffle."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            return [[fingerprint(t.as_py(), shingle) for t in batch.column(batch.schema.get_field_index(text))]]

        return work

    return add_columns(docs, "print bigint", make, (text,))


def _segments(n: int) -> list[tuple[int, int]]:
    """``(offset, width)`` of n segments that cover all bits."""
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(value: Column, segment: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(value, segment[0]).bitwiseAND(F.lit((1 << segment[1]) - 1))


def _flipped(offset: int, width: int) -> list[int]:
    """Numbers with no bit or one bit of the segment set, signed."""
    return [0, *[_signed(1 << (offset + i)) for i in range(width)]]


def _signed(number: int) -> int:
    return number - (1 << BITS) if number >> (BITS - 1) else number


def links(prints: DataFrame, distance: int = DISTANCE, dense_from: int = DENSE_FROM) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``print`` that give the components of the relation
    "differ in at most ``distance`` bits". All links of usual buckets; for dense ones stars around half-way points.
    """
    n = distance + 1
    if distance < 1:
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b")).limit(0)
    if distance % 2:
        dense_from = 1 << 62  # the two halves of an odd distance differ
    ring = _segments(n)
    rows = []
    for i in range(n):
        second = ring[(i + 1) % n]
        flips = F.array(*[F.lit(x).cast("long") for x in _flipped(*second)])
        rows.append(F.struct(F.lit(i).alias("chain"), flips.alias("flips")))
    chained = prints.select("print", F.inline(F.array(*rows)))
    moved = chained.select("print", "chain", F.explode("flips").alias("flip")).withColumn("near", F.col("print").bitwiseXOR(F.col("flip")))

    def key(value: Column) -> Column:
        cases = None
        for i in range(n):
            first, second = _bits(value, ring[i]), _bits(value, ring[(i + 1) % n])
            made = F.shiftleft(first, ring[(i + 1) % n][1]) + second
            cases = F.when(F.col("chain") == i, made) if cases is None else cases.when(F.col("chain") == i, made)
        return cases

    moved = moved.select("print", "chain", "flip", key(F.col("near")).alias("key"))
    exact = moved.filter("flip = 0").select(F.col("print").alias("other"), F.col("chain").alias("c"), "key")
    sizes = exact.groupBy("c", "key").count().filter(F.col("count") > dense_from).select("c", "key")
    dense = write_through(sizes) if dense_from < 1 << 62 else None
    hot = bool(dense is not None and dense.head(1))
    usual, index = moved, exact
    if hot:
        usual = moved.join(dense.withColumnRenamed("c", "chain"), ["chain", "key"], "left_anti")
        index = exact.join(dense, ["c", "key"], "left_anti")
    pairs = usual.join(index, (usual["key"] == index["key"]) & (F.col("chain") == F.col("c")) & (F.col("print") < F.col("other")))
    different = F.col("print").bitwiseXOR(F.col("other"))
    within = None
    for i in range(n):
        spent, ok = F.lit(0), F.lit(True)
        for length in range(1, n + 1):
            spent = spent + F.bit_count(_bits(different, ring[(i + length - 1) % n]))
            ok = ok & (spent <= length * distance // n)
        within = F.when(F.col("chain") == i, ok) if within is None else within.when(F.col("chain") == i, ok)
    found = pairs.filter(within).filter(F.bit_count(different) <= distance).select(F.col("print").alias("a"), F.col("other").alias("b"))
    if not hot:
        return found
    return found.unionByName(_dense_links(moved.join(dense.withColumnRenamed("c", "chain"), ["chain", "key"], "left_semi"), ring, distance))


def _dense_links(members: DataFrame, ring: list[tuple[int, int]], distance: int) -> DataFrame:
    """Stars around the points half way between the fingerprints of a bucket.

    A fingerprint that is in the bucket as it is reaches out by half the distance in the bits outside the two
    segments, one that is there with a flipped bit by one bit less: so whatever meets in a point is within the distance,
    and every pair within the distance meets.
    """
    half, stars = distance // 2, []
    for i in range(len(ring)):
        fixed = {i, (i + 1) % len(ring)}
        free = [o + k for j, (o, w) in enumerate(ring) if j not in fixed for k in range(w)]
        reach = lambda r, free=free: [
            _signed(sum(1 << b for b in chosen)) for size in range(r + 1) for chosen in combinations(free, size)
        ]
        for r, rows in ((half, members.filter("flip = 0")), (half - 1, members.filter("flip != 0"))):
            if r >= 0:
                moves = F.array(*[F.lit(x).cast("long") for x in reach(r)])
                outside = F.lit(_signed(sum(1 << b for b in free))).cast("long")
                stars.append(
                    rows.filter(F.col("chain") == i).select("print", "chain", "key", F.explode(moves).alias("move")).select(
                        "print", "chain", "key", F.col("print").bitwiseAND(outside).bitwiseXOR(F.col("move")).alias("point")
                    )
                )
    points = stars[0]
    for star in stars[1:]:
        points = points.unionByName(star)
    centre = points.groupBy("chain", "key", "point").agg(F.min("print").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return points.join(centre, ["chain", "key", "point"]).filter(F.col("print") != F.col("b")).select(F.col("print").alias("a"), "b").distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, dense_from: int = DENSE_FROM
) -> DataFrame:
    """One row per document: ``doc_id, key, print, component_id`` (the smallest id that links reach, itself included).

    Null texts are empty and, like all texts without words, have the print zero. Null ids are members like others but
    name no component, whose id is null if no member has one. Repeated rows give a row each. Exact copies
    meet in one print before any pair is formed.
    """
    found = _grouped(docs, doc_id, text, shingle, distance, dense_from)
    return found.select("doc_id", "key", "print", F.col("chosen.doc_id").alias("component_id"))


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, distance: int, dense_from: int = DENSE_FROM) -> DataFrame:
    """``doc_id, key, print, chosen`` (id and key of the first document of the component; null ids come last)."""
    chosen = docs.select(quoted(doc_id).alias("doc_id"), text_key(text_of(text)).alias("key"), text_of(text).alias("text"))
    prints = write_through(fingerprints(chosen, shingle=shingle))
    nodes = write_through(prints.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")))
    groups = components(links(nodes.select("print"), distance, dense_from))
    linked = groups.join(nodes, F.col("node") == F.col("print")).select("print", "component", "least")
    named = linked.groupBy("component").agg(F.min("least").alias("chosen"))
    inside = linked.select("print", "component").join(named, "component").select("print", "chosen")
    # Prints without a link are components of their own.
    known = nodes.join(inside, "print", "left").select(F.col("print").alias("p"), F.coalesce("chosen", "least").alias("chosen"))
    return prints.join(known, F.col("print") == F.col("p")).select("doc_id", "key", "print", "chosen")


def hexadecimal(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, with all its columns: the first by id and then by the key of its text.

    Rows that repeat an id and its text are one document and stay together. A document without an id stays only if
    its component has no id.
    """
    found = _grouped(docs, doc_id, text, shingle, distance)
    chosen = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("key") == F.col("chosen.key"))
    gone = found.filter(~chosen).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    same = quoted(doc_id).eqNullSafe(gone["_id"]) & (text_key(text_of(text)) == gone["_key"])
    return docs.join(gone, same, "left_anti")
