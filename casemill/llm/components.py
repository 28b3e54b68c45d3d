"""Connected components by alternating stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casemill.session import discard, write_through

#: Rounds grow with the logarithm of the longest path; more than this is an error, not a partial answer.
MAX_ROUNDS = 60


def _towards_minimum(arcs: DataFrame, larger_only: bool) -> DataFrame:
    """For each node the smallest of its neighbours and itself, joined to its (larger) neighbours and itself.

    ``arcs`` has ``u, v``. The minimum is pre-aggregated, and the join is one Spark can split for a hub.
    """
    least = arcs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    least = least.select("w", F.least("w", "m").alias("m"))
    joined = arcs.join(least, arcs["u"] == least["w"])
    if larger_only:
        joined = joined.filter(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; the component is named by its smallest node.

    Edges may be repeated, reversed or loops (which name no node); nulls are no nodes.
    """
    measures = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
    ordered = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    ordered = ordered.filter((F.col("a") != F.col("b")) & edges[a].isNotNull() & edges[b].isNotNull()).distinct()
    table, seen = write_through(ordered, *measures)
    for _ in range(MAX_ROUNDS):
        if not seen["n"]:
            break
        both = table.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            table.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _towards_minimum(both, True).distinct()
        # Small star: all smaller neighbours of a node, and the node, point to the smallest of them.
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = down.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = least.select(F.col("w").alias("a"), F.col("m").alias("b"))
        following, now = write_through(small.unionByName(own).filter("a != b").distinct(), *measures)
        discard(table)
        table, before, seen = following, seen, now
        if before == now:
            break
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    roots = table.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
