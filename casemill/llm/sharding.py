"""Shard placement by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, ``(offset + j * skip) mod size`` with
offset and skip hashed from its name. The shards take turns; at its turn a shard claims the first slot of its
permutation that is still free. A document hashes to a slot and the slot names its shard. The table depends on
the shard names only, has ``size`` rows whatever the data, and changes little when a shard comes or goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casemill.llm.common import quoted, without

#: Bound of the table that is broadcast, in slots.
MAX_SIZE = 65_537


def _hash(text: str, salt: str) -> str:
    """SQL of a non-negative 60-bit number from the text, equal in other engines."""
    return f"cast(conv(substr(md5(concat('{salt}:', {text})), 1, 15), 16, 10) as bigint)"


def placement_table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """``slot, shard`` with one row for each of ``size`` slots.

    ``size`` must be a prime of at least the number of shards; a hundred times that number keeps the load of
    the shards within a percent. An empty list, repeated or null names and a size that is no prime are errors.
    """
    if not shards or any(s is None for s in shards) or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not len(shards) <= size <= MAX_SIZE or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"size must be a prime between the number of shards and {MAX_SIZE}")
    names = spark.createDataFrame([(i, s) for i, s in enumerate(shards)], "turn int, shard string")
    wishes = names.select(
        "turn",
        F.expr(
            f"transform(sequence(0, {size} - 1), j -> cast(({_hash('shard', 'offset')} % {size} "
            f"+ cast(j as bigint) * ({_hash('shard', 'skip')} % ({size} - 1) + 1)) % {size} as int))"
        ).alias("wish"),
    )
    claimed = wishes.agg(F.sort_array(F.collect_list(F.struct("turn", "wish"))).alias("all")).select(
        # At turn t the shard t mod n takes the head of its list, and the slot leaves all lists.
        F.expr(
            f"aggregate(sequence(0, {size} - 1), "
            "named_struct('free', transform(all, x -> x.wish), 'got', cast(array() as array<int>)), "
            f"(s, t) -> named_struct('free', transform(s.free, w -> array_remove(w, s.free[t % {len(shards)}][0])), "
            f"'got', concat(s.got, array(s.free[t % {len(shards)}][0]))), s -> s.got)"
        ).alias("got")
    )
    turns = claimed.select(F.posexplode("got").alias("t", "slot"))
    return turns.join(
        F.broadcast(names), F.col("t") % len(shards) == F.col("turn")
    ).select("slot", "shard")


def place(df: DataFrame, key: str, shards: list[str], size: int) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` of each row, found by its key in the broadcast table.

    Equal keys meet in one shard; a null key is placed as the empty text. Existing columns ``slot`` and
    ``shard`` are replaced. Rows are neither moved nor dropped.
    """
    slots = placement_table(df.sparkSession, shards, size)
    named = without(df, ["slot", "shard"]).withColumn("slot", slot_of(quoted(key), size))
    return named.join(F.broadcast(slots), "slot", "left").select(
        *[quoted(c) for c in named.columns if c != "slot"], "slot", "shard"
    )


def slot_of(key: Column, size: int) -> Column:
    digest = F.md5(F.concat(F.lit("key:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def write_shards(df: DataFrame, key: str, shards: list[str], size: int, path: str) -> None:
    """Write one folder for each shard. Each task writes its own rows, so no shard is gathered in one task."""
    place(df, key, shards, size).write.partitionBy("shard").parquet(path)
