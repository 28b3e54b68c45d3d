"""Landmark Isomap: shortest paths over the neighbour graph, then classical scaling.

With at least as many landmarks as distinct points this is Isomap itself. Otherwise paths are
found from a fixed number of landmarks to all points (de Silva and Tenenbaum, 2004), so the
work grows with the rows and not with their square.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from casemill.operators.neighbors import knn_join, nearest
from casemill.operators.stages import (
    DefaultParamsReadable,
    DefaultParamsWritable,
    Estimator,
    StatefulModel,
    keyword_only,
    param,
)
from casemill.operators.vectors import as_block, as_lists, block_map, width_of
from casemill.session import discard, write_through

# Landmarks handled side by side as columns of one row.
LANES = 32
# A graph of at most this many edges is broadcast while looking for paths (24 MB).
GRAPH_EDGES = 1_000_000
# A fitted table of at most this many numbers is broadcast when transforming.
BROADCAST_NUMBERS = 4_000_000
# Points of at most this many numbers are broadcast while looking for neighbours (128 MB).
SEARCH_NUMBERS = 16_000_000


class _IsomapParams(HasInputCol, HasOutputCol, HasSeed):
    k = param("k", "number of output dimensions")
    neighbors = param("neighbors", "neighbours of a point in the graph", "int")
    landmarks = param("landmarks", "largest number of landmarks", "int")
    keyCol = param("keyCol", "unique row key", "str")

    def _defaults(self) -> None:
        self._setDefault(
            inputCol="features", outputCol="reduced", k=2, neighbors=5, landmarks=256, seed=0, keyCol="case_id"
        )


def graph_of(points: DataFrame, neighbors: int) -> DataFrame:
    """Symmetric edges ``src, dst, w`` between every point and its nearest points."""
    near = knn_join(points, points, neighbors, exclude_self=True, broadcast_numbers=SEARCH_NUMBERS)
    one = near.select(
        F.col("key").alias("src"), F.col("neighbor").alias("dst"), F.sqrt("distance2").alias("w")
    )
    other = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return one.unionByName(other).groupBy("src", "dst").agg(F.min("w").alias("w"))


def shortest_paths(edges: DataFrame, start: DataFrame, lanes: list[str], rounds: int = 10_000) -> DataFrame:
    """Relax ``start`` (``band, key`` and one distance per lane) along ``edges`` until it is stable.

    A round is one join on the node and one minimum per node and lane, combined within the
    tasks; its result is written, so that the plan does not grow with the rounds.
    """
    total = F.sum(sum(F.coalesce(c, F.lit(0.0)) for c in lanes)).alias("total")
    reached = F.sum(sum(F.col(c).isNotNull().cast("long") for c in lanes)).alias("reached")
    state, before = write_through(start, total, reached)
    for _ in range(rounds):
        moved = state.join(edges, state["key"] == edges["src"]).select(
            "band", F.col("dst").alias("key"), *[(F.col(c) + F.col("w")).alias(c) for c in lanes]
        )
        nearer = state.unionByName(moved).groupBy("band", "key").agg(*[F.min(c).alias(c) for c in lanes])
        last = state
        state, after = write_through(nearer, total, reached)
        discard(last)
        settled = abs(after["total"] - before["total"]) <= 1e-12 * max(1.0, before["total"])
        if after["reached"] == before["reached"] and settled:
            return state
        before = after
    raise RuntimeError(f"paths did not settle within {rounds} rounds")


def settled(away: np.ndarray, first: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Shortest paths from the distances ``away``: edges of node i are ``first[i]`` to ``first[i + 1]``.

    A round follows the edges of the nodes that the last one brought nearer.
    """
    open_nodes = np.flatnonzero(np.isfinite(away))
    while len(open_nodes):
        many = first[open_nodes + 1] - first[open_nodes]
        at = np.arange(many.sum()) + np.repeat(first[open_nodes] - (many.cumsum() - many), many)
        to, length = dst[at], np.repeat(away[open_nodes], many) + w[at]
        nearer = length < away[to]
        to = to[nearer]
        np.minimum.at(away, to, length[nearer])
        moved = np.zeros(len(away), bool)
        moved[to] = True
        open_nodes = np.flatnonzero(moved)
    return away


def paths(edges: DataFrame, start: DataFrame, lanes: list[str]) -> DataFrame:
    """Shortest paths from the distances of ``start``: in the tasks of the bands over a graph that is broadcast if it has at
    most ``GRAPH_EDGES`` edges, otherwise by rounds of joins."""
    held = edges.limit(GRAPH_EDGES + 1).toArrow()
    if held.num_rows > GRAPH_EDGES:
        return shortest_paths(edges, start, lanes)
    src, dst, w = (held[c].to_numpy() for c in ("src", "dst", "w"))
    keys = np.unique(np.concatenate([src, dst]))
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.append(keys, keys[-1] + 1) if len(keys) else [0])
    graph = edges.sparkSession.sparkContext.broadcast((keys, first, np.searchsorted(keys, dst[order]), w[order]))

    def relax(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, first, dst, w = graph.value
        found = np.unique(np.concatenate([keys, pdf["key"].to_numpy()]))
        at = np.searchsorted(found, keys)  # points without an edge keep what they have
        away = np.full((len(lanes), len(found)), np.inf)
        own = np.searchsorted(found, pdf["key"].to_numpy())
        for lane, c in zip(away, lanes):
            np.fmin.at(lane, own, pdf[c].to_numpy(dtype=float))
            lane[at] = settled(lane[at], first, dst, w)
        away[np.isinf(away)] = np.nan
        out = pd.DataFrame(away.T, columns=lanes)
        out.insert(0, "key", found)
        out.insert(0, "band", pdf["band"].iloc[0])
        return out[~np.isnan(away).all(axis=0)]

    schema = "band int, key long, " + ", ".join(f"{c} double" for c in lanes)
    nullable = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in lanes]
    relaxed = start.repartition(max(1, start.sparkSession.sparkContext.defaultParallelism), "band").groupBy("band").applyInPandas(relax, schema)
    return write_through(relaxed.select("band", "key", *nullable))


class Isomap(Estimator, _IsomapParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(
        self, k=2, neighbors=5, landmarks=256, seed=0, inputCol="features", outputCol="reduced", keyCol="case_id"
    ):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> IsomapModel:
        spark = df.sparkSession
        k, seed = self.getOrDefault("k"), self.getOrDefault("seed")
        vectors = df.select(vector_to_array(self.getInputCol()).alias("vector"))
        # Copies share one point: more copies than neighbours would form an island. Points are numbered by themselves, so
        # that repeated or missing keys are rows like others.
        points = write_through(vectors.distinct().withColumn("key", F.monotonically_increasing_id()).select("key", "vector"))
        chosen = points.orderBy(F.xxhash64(F.lit(seed), "vector"), "vector").limit(self.getOrDefault("landmarks")).toArrow()
        ids = chosen["key"].to_numpy()
        places = as_block(chosen["vector"].combine_chunks())
        if not k or k >= len(ids):
            raise ValueError(f"{k} dimensions from {len(ids)} landmarks")

        lanes = [f"c{i}" for i in range(min(LANES, len(ids)))]
        start = spark.createDataFrame(
            [
                (i // len(lanes), int(key), *[0.0 if j == i % len(lanes) else None for j in range(len(lanes))])
                for i, key in enumerate(ids)
            ],
            "band int, key long, " + ", ".join(f"{c} double" for c in lanes),
        )
        edges = write_through(graph_of(points, self.getOrDefault("neighbors")))
        state = paths(edges, start, lanes)
        state = self._bridge(points, edges, state, ids, places, lanes)

        bands = state.groupBy("key").agg(
            F.array_sort(F.collect_list(F.struct("band", F.array(*lanes).alias("d")))).alias("b")
        )
        away = F.slice(F.flatten(F.transform("b", lambda x: x["d"])), 1, len(ids))
        table = write_through(points.join(bands.select("key", away.alias("away")), "key"))
        for used in (points, edges, state):
            discard(used)

        # Landmarks x landmarks distances: bounded by the landmarks parameter.
        own = table.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "key long")), "key")
        rows = {r["key"]: r["away"] for r in own.select("key", "away").collect()}
        between = np.array([rows[int(i)] for i in ids], dtype=float)
        squares = np.minimum(between, between.T) ** 2
        center = np.eye(len(ids)) - 1.0 / len(ids)
        values, basis = np.linalg.eigh(-0.5 * center @ squares @ center)
        top = np.argsort(values)[::-1][:k]
        scale = np.where(values[top] > 1e-12 * values.max(), values[top], np.inf)
        matrix = -0.5 * basis[:, top] / np.sqrt(scale)
        return self._copyValues(IsomapModel(table, matrix, squares.mean(axis=0)))

    def _bridge(self, points, edges, state, ids, places, lanes) -> DataFrame:
        """Connect the parts of a graph that falls apart, by straight lines through landmarks.

        A point that no landmark reaches is tied to its nearest landmark, and landmarks that do
        not reach each other are tied pairwise.
        """
        spark, n = points.sparkSession, points.count()
        reached = sum(F.count(c) for c in lanes)
        if state.agg(reached.alias("r")).first()["r"] == n * len(ids):
            return state
        landmarks = spark.createDataFrame(
            [(int(i), [float(x) for x in v]) for i, v in zip(ids, places)], "key long, vector array<double>"
        )
        lost = points.join(state.select("key").distinct(), "key", "left_anti")
        ties = knn_join(lost, landmarks, 1).select(
            F.col("key").alias("src"), F.col("neighbor").alias("dst"), F.sqrt("distance2").alias("w")
        )
        seen = {
            (r["band"] * len(lanes) + j, r["key"])
            for r in state.join(F.broadcast(landmarks.select("key")), "key").collect()
            for j, c in enumerate(lanes)
            if r[c] is not None
        }
        pairs = [
            (int(b), int(a), float(np.linalg.norm(places[i] - places[j])))
            for i, a in enumerate(ids)
            for j, b in enumerate(ids)
            if i < j and (i, int(b)) not in seen
        ]
        lines = spark.createDataFrame(pairs, "src long, dst long, w double")
        added = ties.unionByName(lines)
        back = added.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        return paths(write_through(edges.unionByName(added).unionByName(back)), state, lanes)


class IsomapModel(StatefulModel, _IsomapParams):
    """Fitted points with their path lengths to the landmarks, and the projection."""

    def __init__(self, table: DataFrame | None = None, matrix: np.ndarray | None = None, means: np.ndarray | None = None):
        super().__init__()
        self._defaults()
        self.table, self.matrix, self.means = table, matrix, means

    def _state(self):
        return {"matrix": self.matrix.tolist(), "means": self.means.tolist()}, {"points": self.table}

    def _restore(self, small, table) -> None:
        self.matrix, self.means = np.array(small["matrix"]), np.array(small["means"])
        self.table = table("points")

    def _transform(self, df: DataFrame) -> DataFrame:
        spark, k = df.sparkSession, self.getOrDefault("neighbors")
        column, out = self.getInputCol(), self.getOutputCol()
        projection = spark.sparkContext.broadcast((self.matrix, self.means))
        # Path lengths of a new point lead through its nearest fitted points.
        per_row = len(self.means) + width_of(df, column)
        rows = self.table.select("key", "vector", "away").limit(BROADCAST_NUMBERS // per_row + 1).toArrow()
        if rows.num_rows * per_row <= BROADCAST_NUMBERS:
            held = spark.sparkContext.broadcast(
                (
                    rows["key"].to_numpy(),
                    as_block(rows["vector"].combine_chunks()),
                    as_block(rows["away"].combine_chunks()),
                )
            )

            def place(block: np.ndarray) -> np.ndarray:
                keys, fitted, away = held.value
                matrix, means = projection.value
                near, squares = nearest(block, fitted, keys, k)
                lengths = np.full((len(block), away.shape[1]), np.inf)
                for j in range(near.shape[1]):
                    np.minimum(lengths, np.sqrt(squares[:, j, None]) + away[near[:, j]], out=lengths)
                return (lengths**2 - means) @ matrix

            return df.select("*", block_map(F.col(column), place, out, self.matrix.shape[1]))

        numbered = write_through(df.withColumn("_row", F.monotonically_increasing_id()))
        queries = numbered.select(F.col("_row").alias("key"), vector_to_array(column).alias("vector"))
        # A fitted point has its own path lengths; only the others look for fitted points.
        fitted = self.table.select(F.col("key").alias("neighbor"), "vector")
        own = queries.join(fitted, "vector").select(F.col("key").alias("_query"), "neighbor")
        lost = queries.join(fitted, "vector", "left_anti")
        near = knn_join(lost, self.table.select("key", "vector"), k, broadcast_numbers=SEARCH_NUMBERS).withColumnRenamed("key", "_query")
        steps = near.join(self.table.select(F.col("key").alias("neighbor"), "away"), "neighbor")
        # At most ``neighbors`` entries per query.
        grouped = steps.groupBy("_query").agg(
            F.collect_list(F.struct(F.sqrt("distance2").alias("w"), "away")).alias("_steps")
        )

        def project(lists: pa.Array) -> pa.Array:
            matrix, means = projection.value
            lengths = np.empty((len(lists), len(means)))
            for i, entries in enumerate(lists):
                fields = entries.values
                block = as_block(fields.field("away")) + fields.field("w").to_numpy()[:, None]
                lengths[i] = block.min(axis=0)
            return as_lists((lengths**2 - means) @ matrix)

        def project_own(lists: pa.Array) -> pa.Array:
            matrix, means = projection.value
            if len(lists) == 0:
                return pa.array([], pa.list_(pa.float64()))
            return as_lists((as_block(lists) ** 2 - means) @ matrix)

        placed = grouped.select("_query", arrow_udf(project, "array<double>")("_steps").alias(out))
        kept = own.join(self.table.select(F.col("key").alias("neighbor"), "away"), "neighbor")
        kept = kept.select("_query", arrow_udf(project_own, "array<double>")("away").alias(out))
        vectors = placed.unionByName(kept).select("_query", array_to_vector(out).alias(out, metadata={"ml_attr": {"num_attrs": self.matrix.shape[1]}}))
        return numbered.join(vectors, F.col("_row") == F.col("_query"), "left").drop("_query", "_row")
