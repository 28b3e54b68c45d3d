"""Many candidates of a search from shared passes over one table of vectors.

One pass over the training rows gives the counts and sums of the classes and the Gram matrix. From these the driver has the principal
components, the singular vectors, and the discriminant analysis of every projection and shrinkage, with matrices no
larger than d x d. Projections to fewer dimensions are the leading columns of the largest one. Neighbours are searched
once per projection, from fewer dimensions to more, with the largest number of neighbours asked for; fewer ones are the first of
them. Rows with the same vector are one point, which keeps no more rows than a search can ask for.
All predictions of a row are made by one pass, as one array.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf

from casemill.operators.neighbors import BROADCAST_NUMBERS, Search, vote
from casemill.operators.vectors import as_block, as_lists, check_width, packed, summed, width_of

#: Numbers of all models of a pass together, which are broadcast (64 MB).
MODEL_NUMBERS = 8_000_000
#: Numbers of the training points that are broadcast for a search (192 MB).
POINT_NUMBERS = 24_000_000
#: Rows of points that are put in order at a time.
ROW_NUMBERS = 2_000_000
#: Scores that are held at a time while predicting (32 MB).
SCORE_NUMBERS = 4_000_000


class Moments(NamedTuple):
    """Rows of each class, their sums, and the Gram matrix of all rows."""

    counts: np.ndarray
    sums: np.ndarray
    gram: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums.sum(0) / max(self.counts.sum(), 1.0)


def moments(df: DataFrame, features: str, label: Column, classes: int) -> Moments:
    d = width_of(df, features)
    check_width(d)

    def partial(parts):
        counts, sums, gram = np.zeros(classes), np.zeros((classes, d)), np.zeros((d, d))
        for x, y in parts:
            counts += np.bincount(y, minlength=classes)
            np.add.at(sums, y, x)
            gram += x.T @ x
        return np.concatenate([counts, sums.ravel(), gram.ravel()])

    total = summed(packed(df, features, label), partial, classes * (d + 1) + d * d)
    counts, sums, gram = np.split(total, [classes, classes * (d + 1)])
    if not counts.sum():
        raise ValueError("no rows to fit on")
    return Moments(counts, sums.reshape(classes, d), gram.reshape(d, d))


def _leading(matrix: np.ndarray, k: int) -> np.ndarray:
    """Leading eigenvectors, with the largest entry of each positive; zero beyond the rank."""
    values, vectors = np.linalg.eigh(matrix)
    top = np.argsort(values)[::-1][:k]
    chosen = vectors[:, top] * (values[top] > 1e-13 * max(values.max(), 0.0))
    return chosen * np.where(chosen[np.abs(chosen).argmax(0), np.arange(k)] < 0, -1.0, 1.0)


def principal(m: Moments, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Components and offset of the centred rows; ``k`` None takes as many as there can be."""
    n, d = int(m.counts.sum()), len(m.gram)
    k = k or min(n, d)
    if k > min(n, d):
        raise ValueError(f"{k} components from {n} rows of {d} features")
    components = _leading(m.gram - n * np.outer(m.mean, m.mean), k)
    return components, -m.mean @ components


def singular(m: Moments, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors, without centring; beyond the rank the projections of the rows are zero anyway."""
    d = len(m.gram)
    if k is None or k > d:
        raise ValueError(f"{k} components from {d} features")
    return _leading(m.gram, k), np.zeros(k)


def discriminant(means: np.ndarray, sizes: np.ndarray, covariance: np.ndarray, shrinkage: float | None):
    """Weights and bias by least squares on the (shrunk) within-class covariance. A class without rows never wins."""
    if (sizes > 0).sum() < 2:
        raise ValueError("discriminant analysis needs at least two classes")
    weight, d = shrinkage or 0.0, len(covariance)
    shrunk = (1 - weight) * covariance + weight * np.trace(covariance) / d * np.eye(d)
    weights = np.linalg.lstsq(shrunk, means.T, rcond=None)[0].T
    with np.errstate(divide="ignore"):
        bias = -0.5 * np.einsum("ij,ij->i", means, weights) + np.log(sizes / sizes.sum())
    weights[sizes == 0] = 0.0
    return weights, bias


def discriminant_of(m: Moments, projection: tuple | None, shrinkage: float | None):
    """The same for projected rows, from the moments of the rows themselves."""
    means = m.sums / np.maximum(m.counts, 1.0)[:, None]
    covariance = (m.gram - (means * m.counts[:, None]).T @ means) / m.counts.sum()
    if projection is not None:
        matrix, offset = projection
        means, covariance = means @ matrix + offset, matrix.T @ covariance @ matrix
    return discriminant(np.where(m.counts[:, None] > 0, means, 0.0), m.counts, covariance, shrinkage)


class Linear(NamedTuple):
    space: str
    n: int
    weights: np.ndarray
    bias: np.ndarray


class Neighbours(NamedTuple):
    space: str
    n: int
    ks: list[int]


class Constant(NamedTuple):
    label: float


class Training(NamedTuple):
    """Training points and their rows, those of a point one after the other; ``places`` orders all rows by key and label."""

    vectors: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    labels: np.ndarray

    def nearest_labels(self, points: np.ndarray, away: np.ndarray, k: int) -> np.ndarray:
        """Labels of the ``k`` nearest rows, from the ``k`` nearest points of each query: equal distances go by the place."""
        many = np.minimum(np.diff(self.starts), k)
        if len(many) == len(self.labels):  # each point is one row
            return self.labels[points]
        k, out = min(k, len(self.labels)), []
        step = max(1, ROW_NUMBERS // (k * k))
        for first in range(0, len(points), step):
            some = points[first : first + step]
            counts = many[some].ravel()
            at = np.arange(counts.sum()) + np.repeat(self.starts[some].ravel() - (counts.cumsum() - counts), counts)
            row = np.repeat(np.repeat(np.arange(len(some)), some.shape[1]), counts)
            at = at[np.lexsort((self.places[at], np.repeat(away[first : first + step].ravel(), counts), row))]
            held = counts.reshape(some.shape).sum(axis=1)
            out.append(self.labels[at[(np.append(0, held.cumsum()[:-1])[:, None] + np.arange(k)).ravel()]].reshape(-1, k))
        return np.concatenate(out)


class Predictor(NamedTuple):
    """``spaces`` are projections (or None for the rows themselves) by name; the models use the leading ``n`` columns of
    one of them. ``train`` are the training points, if a model looks for neighbours."""

    spaces: dict[str, tuple | None]
    models: list
    train: Training | None = None

    @property
    def size(self) -> int:
        held = [m.weights for m in self.models if isinstance(m, Linear)]
        held += [p[0] for p in self.spaces.values() if p is not None]
        return sum(x.size for x in held)

    def column(self, df: DataFrame, features: str, broadcasts: list | None = None) -> Column:
        """All predictions of a row as an array: one entry per model, of neighbours one per number of them.

        What is broadcast is added to ``broadcasts``, so that it can be given up.
        """
        shared = df.sparkSession.sparkContext.broadcast(tuple(self))
        if broadcasts is not None:
            broadcasts.append(shared)
        held: dict = {}

        def place(name, rows, spaces):
            projection = spaces[name]
            return rows if projection is None else rows @ projection[0] + projection[1]

        def run(lists: pa.Array) -> pa.Array:
            if len(lists) == 0:
                return pa.array([], pa.list_(pa.float64()))
            spaces, models, train = shared.value
            block = as_block(lists)
            placed = {name: place(name, block, spaces) for name in spaces}
            out, near = [], {}
            for name in {m.space: None for m in models if isinstance(m, Neighbours)}:
                wanted = sorted((m.n, max(m.ks)) for m in models if isinstance(m, Neighbours) and m.space == name)
                if name not in held:
                    points = place(name, train.vectors, spaces)
                    held[name] = Search(points, train.places[train.starts[:-1]], wanted)
                near.update({(name, n): (k, *found) for (n, k), found in zip(wanted, held[name].nearest(placed[name]))})
            for m in models:
                if isinstance(m, Constant):
                    out.append(np.full(len(block), m.label))
                elif isinstance(m, Linear):
                    rows, step = placed[m.space][:, : m.n], max(1, SCORE_NUMBERS // len(m.bias))
                    parts = [rows[i : i + step] for i in range(0, len(rows), step)]
                    out.append(np.concatenate([(p @ m.weights.T + m.bias).argmax(1) for p in parts]).astype(float))
                else:
                    k, points, away = near[m.space, m.n]
                    labels = train.nearest_labels(points, away, k)
                    out += [vote(labels[:, :k]) for k in m.ks]
            return as_lists(np.stack(out, axis=1))

        return arrow_udf(run, "array<double>")(vector_to_array(features))


def training_rows(df: DataFrame, key: str, features: str, label: str) -> Training | None:
    """Rows in the order of key and label, as ``KNeighbors`` has them, each a point; None if there are too many to broadcast."""
    d = width_of(df, features)
    rows = df.select(
        F.col(key).cast("long").alias("key"), vector_to_array(features).alias("vector"), F.col(label).cast("double").alias("label")
    )
    if df.count() * d > BROADCAST_NUMBERS:
        return None
    rows = rows.toArrow()
    rows = rows.take(_order(rows))
    places = np.arange(rows.num_rows + 1)
    return Training(as_block(rows["vector"].combine_chunks()), places, places[:-1], rows["label"].to_numpy())


def _order(rows: pa.Table) -> pa.Array:
    by = [("key", "ascending"), ("label", "ascending")]
    return pc.sort_indices(rows.select(["key", "label"]), by, null_placement="at_start")


def training_points(points: DataFrame, rows: DataFrame, key: str, features: str, label: str, k: int) -> Training | None:
    """The same from ``points`` with a number ``_point`` and a vector, and ``rows`` with the number of their point.

    Of each point the first ``k`` rows are kept, more are never asked for. None if there are too many points to broadcast.
    """
    d = width_of(points, features)
    used = points.join(rows.select("_point").distinct(), "_point", "left_semi")
    if used.count() * d > POINT_NUMBERS:
        return None
    first = F.row_number().over(W.partitionBy("_point").orderBy("key", "label"))
    kept = rows.select("_point", F.col(key).cast("long").alias("key"), F.col(label).cast("double").alias("label"))
    kept = kept.withColumn("_first", first).filter(F.col("_first") <= k).drop("_first").toArrow()
    kept = kept.take(_order(kept))
    of = kept["_point"].to_numpy()
    by_point = np.argsort(of, kind="stable")  # the places of a point ascend
    names, starts = np.unique(of[by_point], return_index=True)
    vectors = used.select("_point", vector_to_array(features).alias("vector")).toArrow()
    vectors = vectors.take(pa.array(np.argsort(vectors["_point"].to_numpy())))
    assert (vectors["_point"].to_numpy() == names).all()
    block = as_block(vectors["vector"].combine_chunks())
    return Training(block, np.append(starts, len(of)), by_point, kept["label"].to_numpy()[by_point])
