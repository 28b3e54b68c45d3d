"""First matching closed range of a key, for single keys and for lists of keys."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.scalar import category_of, in_closed_range
from casemill.schema import ICD10_BLOCKS

INLINE_LIMIT = 64
MASK_LIMIT = 62


class Range(NamedTuple):
    lo: str
    hi: str
    value: str | int


def ranges_of_blocks(blocks: Sequence[str]) -> list[Range]:
    """``A00-B99`` gives the range from ``A00`` to ``B99`` with the block as its value."""
    return [Range(*block.split("-"), block) for block in blocks]


ICD10_RANGES = ranges_of_blocks(ICD10_BLOCKS)


def small_ranges(ranges: DataFrame, lo="lo", hi="hi", value="block", order="pos") -> list[Range] | None:
    """The range table as a list, or None when it has more than ``INLINE_LIMIT`` rows."""
    rows = ranges.select(order, lo, hi, value).limit(INLINE_LIMIT + 1).collect()
    if len(rows) > INLINE_LIMIT:
        return None
    return [Range(r[lo], r[hi], r[value]) for r in sorted(rows, key=lambda r: r[order])]


def first_range(key: Column, ranges: Sequence[Range]) -> Column:
    """Value of the first range holding ``key``, null if none does.

    The bounds become constants of nested comparisons, halving the candidates at each step, so
    the lookup is a projection: it needs no join and no shuffle, and tests few bounds per key.
    """
    order = lambda text: text.encode("utf8")
    # A cut lies just before (0) or just after (1) a bound.
    cuts = sorted({(order(r.lo), 0, r.lo) for r in ranges} | {(order(r.hi), 1, r.hi) for r in ranges})
    pieces: list = [None]
    for text, after, _ in cuts:
        held = (r for r in ranges if order(r.lo) <= text and (text, after) < (order(r.hi), 1))
        pieces.append(next((r.value for r in held), None))

    def choose(low: int, high: int) -> Column:
        """The value between the cuts ``low`` and ``high``; a null key takes the first piece."""
        if len(set(pieces[low : high + 1])) == 1:
            return F.lit(pieces[low])
        middle = (low + high) // 2
        _, after, bound = cuts[middle]
        beyond = (key > F.lit(bound)) if after else (key >= F.lit(bound))
        return F.when(beyond, choose(middle + 1, high)).otherwise(choose(low, middle))

    found = choose(0, len(cuts))
    number = bool(ranges) and isinstance(ranges[0].value, int)
    return found.cast("long" if number else "string")


def block_mask(key: Column, ranges: Sequence[Range] = ICD10_RANGES) -> Column:
    """The block of a key as one bit of a long, for aggregation with ``bit_or``.

    Bits follow the sorted values; the bit after the last marks a key without a block. A long
    is combined in place by hash aggregation, where a set of strings is an object that makes
    Spark sort.
    """
    values = _sorted_values(ranges)
    bits = [Range(r.lo, r.hi, 1 << values.index(r.value)) for r in ranges]
    return F.coalesce(first_range(key, bits), F.lit(1 << len(values)).cast("long"))


def blocks_of_mask(mask: Column, ranges: Sequence[Range] = ICD10_RANGES) -> Column:
    """Sorted blocks of an aggregated mask, a last null for unmatched keys; no mask gives []."""
    values = _sorted_values(ranges)
    numbered = F.array(
        *[F.struct(F.lit(i).alias("bit"), F.lit(v).alias("value")) for i, v in enumerate([*values, None])]
    )
    has = F.coalesce(mask, F.lit(0).cast("long"))
    return F.filter(numbered, lambda x: F.bit_get(has, x["bit"]) == 1)["value"]


def label_of_mask(mask: Column, ranges: Sequence[Range] = ICD10_RANGES) -> Column:
    """The rendered list of ``blocks_of_mask``, as one compiled expression."""
    names = [*[f"'{v}'" for v in _sorted_values(ranges)], "None"]
    has = F.coalesce(mask, F.lit(0).cast("long"))
    shown = [F.when(has.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]
    return F.concat(F.lit("["), F.concat_ws(", ", *shown), F.lit("]"))


def _sorted_values(ranges: Sequence[Range]) -> list[str]:
    values = sorted({r.value for r in ranges})
    if len(values) > MASK_LIMIT:
        raise ValueError(f"a mask holds at most {MASK_LIMIT} blocks; explode and use range_lookup")
    return values


def blocks_of_codes(
    codes: Column,
    ranges: Sequence[Range] = ICD10_RANGES,
    category_only: bool = False,
    strict: bool = False,
) -> Column:
    """Sorted distinct blocks of a list of codes, an unmatched code giving a last null.

    ``category_only`` compares the three-character category, so that ``B99.9`` falls in
    ``A00-B99``; by default the whole code is compared and ``B99.9`` matches nothing.
    ``strict`` fails the job on an unmatched code.
    """

    def lookup(code: Column) -> Column:
        hit = first_range(category_of(code) if category_only else code, ranges)
        if strict:
            failure = F.raise_error(F.concat(F.lit("no block for code "), code)).cast("string")
            hit = F.coalesce(hit, failure)
        return hit

    codes = F.coalesce(codes, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.transform(codes, lookup)))


def range_lookup(
    df: DataFrame,
    key: str,
    ranges: DataFrame,
    lo: str = "lo",
    hi: str = "hi",
    value: str = "block",
    order: str = "pos",
    out: str = "block",
    salts: int = 8,
) -> DataFrame:
    """Add ``out``, the value of the first range (by ``order``) that holds ``key``.

    A table of at most ``INLINE_LIMIT`` ranges is inlined. A larger one is joined on the
    first character, for distinct keys only: a range is copied to every first character it
    spans and to every salt, a key belongs to one of each, so that a crowded letter is
    spread over ``salts`` tasks and only true hits leave the join.
    """
    inlined = small_ranges(ranges, lo, hi, value, order)
    if inlined is not None:
        return df.withColumn(out, first_range(F.col(key), inlined))

    # Of ranges with equal bounds only the first can win.
    spread = (
        ranges.filter(F.col(lo) <= F.col(hi))
        .groupBy(F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
        .agg(F.min_by(value, order).alias("_value"), F.min(order).alias("_order"))
        .withColumn("_letter", F.explode(F.sequence(F.ascii("_lo"), F.ascii("_hi"))))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    keys = df.select(F.col(key).alias("_key")).filter("_key is not null").distinct().select(
        "_key",
        F.ascii("_key").alias("_letter"),
        F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int").alias("_salt"),
    )
    hits = (
        keys.join(spread, ["_letter", "_salt"])
        .filter(in_closed_range(F.col("_key"), F.col("_lo"), F.col("_hi")))
        .groupBy("_key")
        .agg(F.min_by("_value", "_order").alias(out))
    )
    return df.join(hits, df[key] == hits["_key"], "left").drop("_key")


def blocks_of_codes_joined(
    df: DataFrame, key: str, codes: str, ranges: DataFrame, category_only: bool = False, out: str = "blocks"
) -> DataFrame:
    """``blocks_of_codes`` for a range table too large to inline; adds ``out`` to ``df``."""
    single = df.select(key, F.explode(codes).alias("_code"))
    if category_only:
        single = single.withColumn("_code", category_of(F.col("_code")))
    found = (
        range_lookup(single, "_code", ranges, out="_block")
        .groupBy(key)
        .agg(
            F.collect_set("_block").alias("_set"),
            F.max(F.col("_block").isNull()).alias("_unmatched"),
        )
    )
    return (
        df.join(found, key, "left")
        .withColumn(out, sorted_blocks(F.col("_set"), F.col("_unmatched")))
        .drop("_set", "_unmatched")
    )


def sorted_blocks(blocks: Column, unmatched: Column) -> Column:
    """Aggregated blocks as a sorted list; ``unmatched`` adds the null that sets leave out."""
    empty = F.array().cast("array<string>")
    last = F.when(unmatched, F.array(F.lit(None).cast("string"))).otherwise(empty)
    return F.concat(F.sort_array(F.coalesce(blocks, empty)), last)
