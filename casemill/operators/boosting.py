"""Multi-class gradient boosting: all trees of a round grow over the same passes.

A round fits one regression tree per class to the residuals of the softmax. One Spark job per level gives, for every open
node of every class, the rows, residuals and curvatures in each bin of each feature; the best cuts follow from these sums
(largest decrease of squared error) and so do the values of the leaves (one Newton step). So a round takes as many jobs
as its trees are deep, however many classes there are. Scores of the rows are kept in a written table that is renewed every
few rounds; in between they follow from the trees made since, so a lost executor costs a re-read of that table.

Features are cut into bins at values of a sample of the rows: all midpoints between different values where these are few.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from casemill.operators.stages import (
    ClassifierParams,
    DefaultParamsReadable,
    DefaultParamsWritable,
    Estimator,
    StatefulModel,
    keyword_only,
    param,
)
from casemill.operators.vectors import CHUNK, as_block, block_score, blocks_of, packed, summed, width_of
from casemill.session import discard, write_through

#: Rows, and numbers in them, from which the cuts between bins are taken.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 8_000_000
#: Rounds after which the scores of all rows are written anew.
RENEW = 10
#: Numbers in the sums of one job (32 MB); more open nodes take several jobs.
NUMBERS = 4_000_000


class Tree(NamedTuple):
    """Nodes of a tree; a row goes to ``left`` or behind it. A leaf has the feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def nodes_of(self, rows: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row; ``start`` are nodes that the rows are known to reach."""
        node = np.zeros(len(rows), np.int64) if start is None else start.copy()
        at = np.arange(len(rows))
        while len(at):
            at = at[self.feature[node[at]] >= 0]
            here = node[at]
            node[at] = self.left[here] + (rows[at, self.feature[here]] > self.cut[here])
        return node


class Growing:
    """A tree to which levels are added."""

    def __init__(self):
        self.feature, self.cut, self.left, self.value = [-1], [-1], [-1], [0.0]

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> list[int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, first
        for column, new in ((self.feature, -1), (self.cut, -1), (self.left, -1)):
            column += [new, new]
        self.value += values
        return [first, first + 1]

    def cuts(self) -> Tree:
        """The tree without the values of its nodes."""
        return Tree(np.array(self.feature), np.array(self.cut), np.array(self.left), None)

    def tree(self) -> Tree:
        return self.cuts()._replace(value=np.array(self.value))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cuts_of(column: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` increasing values between the values of a column."""
    values = np.unique(column)
    if len(values) > bins:
        below = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="inverted_cdf"))
        at = np.searchsorted(values, below[below < values[-1]])
    else:
        at = np.arange(len(values) - 1)
    return (values[at] + values[at + 1]) / 2


def add_trees(scores: np.ndarray, rows: np.ndarray, rounds: list[list[Tree]], step: float) -> np.ndarray:
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[:, k] += step * tree.value[tree.nodes_of(rows)]
    return scores


def best_cut(rows: np.ndarray, pull: np.ndarray) -> tuple[float, int, int]:
    """The largest decrease of squared error, its feature and bin, from sums ``(d, bins)``; the first one on ties."""
    left, g = rows.cumsum(axis=1), pull.cumsum(axis=1)
    right, rest = left[:, -1:] - left, g[:, -1:] - g
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left * right / (left + right) * (g / left - rest / right) ** 2
    gain[(left == 0) | (right == 0)] = 0.0
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def node_cut(sums: np.ndarray) -> list[float]:
    """The best cut of a node with sums ``(3, d, bins)``: gain, feature and bin, the sums of its left side and of all rows in
    the feature, and residuals and curvatures of all rows."""
    rows, pull, curve = sums
    gain, feature, cut = best_cut(rows, pull)
    along = [a[feature].cumsum() for a in sums]
    return [gain, feature, cut, *(a[cut] for a in along), *(a[-1] for a in along), pull[0].sum(), curve[0].sum()]


def _scored_blocks(batches):
    for batch in batches:
        for codes, labels, scores in zip(*(batch.column(i) for i in range(3))):
            y = labels.values.to_numpy(zero_copy_only=False)
            yield (
                np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(y), -1),
                y,
                np.frombuffer(scores.as_buffer()).reshape(len(y), -1).copy(),
            )


_BLOCKS = "codes binary, y array<int>, scores binary"


def _block_batch(codes: np.ndarray, y: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    labels = pa.ListArray.from_arrays(pa.array([0, len(y)], pa.int32()), pa.array(y, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array([codes.tobytes()], pa.binary()), labels, pa.array([scores.tobytes()], pa.binary())], ["codes", "y", "scores"]
    )


class GradientBoosting(Estimator, ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees under the softmax loss. ``depth`` None or above the rows has no effect as a bound."""

    rounds = param("rounds", "number of rounds", "int")
    depth = param("depth", "levels of cuts in a tree; None is no bound")
    step = param("step", "share of a tree's values that is added", "float")
    bins = param("bins", "bins of a feature, 256 at most", "int")

    @keyword_only
    def __init__(
        self, rounds=100, depth=3, step=0.1, bins=32, seed=0,
        featuresCol="features", labelCol="label", predictionCol="prediction",
    ):
        super().__init__()
        self._setDefault(rounds=100, depth=3, step=0.1, bins=32, seed=0, keyCol="case_id")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> GradientBoostingModel:
        features, label = self.getFeaturesCol(), F.col(self.getLabelCol()).cast("int")
        rounds, depth, step, bins = (self.getOrDefault(n) for n in ("rounds", "depth", "step", "bins"))
        if not 2 <= bins <= 256:
            raise ValueError(f"bins must be between 2 and 256, not {bins}")
        counts = {r["y"]: r["n"] for r in df.groupBy(label.alias("y")).agg(F.count("*").alias("n")).collect()}
        if not counts:
            raise ValueError("no rows to fit on")
        classes, n = sorted(counts), sum(counts.values())
        start = np.log([counts[c] / n for c in classes])
        made: list[list[Tree]] = []
        if len(classes) > 1:
            cuts = self._cuts(df, features, bins)
            made = self._rounds(df, features, label, classes, start, cuts, rounds, depth, step)
            empty = [cuts[i] if len(cuts[i]) else np.zeros(1) for i in range(len(cuts))]
            limit = lambda t: np.array([empty[f][c] if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)])
            made = [[t._replace(cut=limit(t)) for t in trees] for trees in made]
        return self._copyValues(GradientBoostingModel(classes, start, made, step))

    @staticmethod
    def _cuts(df: DataFrame, features: str, bins: int) -> list[np.ndarray]:
        x, most = vector_to_array(features).alias("x"), min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // max(width_of(df, features), 1)))
        # The rows with the least hashes, whatever the partitions.
        some = as_block(df.select(x).orderBy(F.xxhash64("x")).limit(most).toArrow().column(0).combine_chunks())
        return [cuts_of(column, bins) for column in some.T]

    def _rounds(self, df, features, label, classes, start, cuts, rounds, depth, step) -> list[list[Tree]]:
        spark, width, n_bins = df.sparkSession, len(cuts), max(map(len, cuts)) + 1
        per_node = 3 * width * n_bins
        if per_node > 16 * NUMBERS:
            raise ValueError(f"{width} features of {n_bins} bins exceed the {16 * NUMBERS} numbers that one node may have")
        shared = spark.sparkContext.broadcast((cuts, np.array(classes), start))

        def binned(batches):
            cuts, classes, start = shared.value
            for x, y in blocks_of(batches):
                codes = np.empty(x.shape, np.uint8)
                for i, c in enumerate(cuts):
                    codes[:, i] = np.searchsorted(c, x[:, i], side="left")
                yield _block_batch(codes, np.searchsorted(classes, y), np.tile(start, (len(y), 1)))

        table = write_through(packed(df, features, label).mapInArrow(binned, _BLOCKS))
        blocks = table.persist()
        partitions, made, fresh = blocks.rdd.getNumPartitions(), [], []
        try:
            for _ in range(rounds):
                if len(fresh) == RENEW:
                    known = spark.sparkContext.broadcast(fresh)

                    def renewed(batches, known=known):
                        for codes, y, scores in _scored_blocks(batches):
                            yield _block_batch(codes, y, add_trees(scores, codes, known.value, step))

                    old, before = table, blocks
                    table = write_through(blocks.mapInArrow(renewed, _BLOCKS))
                    blocks = table.persist()
                    partitions, fresh = blocks.rdd.getNumPartitions(), []
                    before.unpersist()
                    discard(old)
                trees = self._round(blocks, partitions, fresh, len(classes), width, n_bins, depth, step)
                made.append(trees)
                fresh.append(trees)
        finally:
            blocks.unpersist()
            discard(table)
        return made

    @staticmethod
    def _round(blocks, partitions, fresh, classes, width, n_bins, depth, step) -> list[Tree]:
        spark, growing = blocks.sparkSession, [Growing() for _ in range(classes)]
        nodes, per_node, level = [(k, 0) for k in range(classes)], 3 * width * n_bins, 0
        while nodes and (depth is None or level < depth):
            following = []
            many = max(1, NUMBERS // per_node)
            for first in range(0, len(nodes), many):
                chosen = nodes[first : first + many]
                shared = spark.sparkContext.broadcast((fresh, [g.tree() for g in growing], chosen))

                def level_sums(parts, shared=shared, size=len(chosen)):
                    fresh, trees, chosen = shared.value
                    slots = [np.full(len(t.feature), -1) for t in trees]
                    for slot, (k, node) in enumerate(chosen):
                        slots[k][node] = slot
                    total = None
                    for codes, y, scores in parts:
                        if total is None:
                            total = np.zeros((3, size * width * n_bins))
                        chances = softmax(add_trees(scores, codes, fresh, step))
                        for k, tree in enumerate(trees):
                            slot = slots[k][tree.nodes_of(codes)]
                            at = np.flatnonzero(slot >= 0)
                            if not len(at):
                                continue
                            pull = (y[at] == k) - chances[at, k]
                            key = ((slot[at, None] * width + np.arange(width)) * n_bins + codes[at]).ravel()
                            for i, weight in enumerate((np.ones(len(at)), pull, np.abs(pull) * (1 - np.abs(pull)))):
                                total[i] += np.bincount(key, np.repeat(weight, width), total.shape[1])
                    # The sums of a node follow each other.
                    return None if total is None else total.reshape(3, size, -1).swapaxes(0, 1).ravel()

                def cut_of(sums):
                    return node_cut(sums.reshape(3, width, n_bins))

                size = len(chosen) * per_node
                if per_node <= CHUNK:  # the task that adds up a node finds its cut
                    found = summed(blocks, level_sums, size, partitions, _scored_blocks, per_node, cut_of)
                else:
                    sums = summed(blocks, level_sums, size, partitions, _scored_blocks)
                    found = [cut_of(node) for node in sums.reshape(len(chosen), -1)]
                shared.unpersist()
                for (k, node), (gain, feature, cut, *numbers) in zip(chosen, found):
                    left, whole = numbers[:3], numbers[3:6]
                    if gain <= 1e-12:
                        if not node:  # a tree without a cut has the value of all rows
                            growing[k].value[0] = _leaf(*numbers[6:], classes)
                        continue
                    sides = [tuple(left), tuple(w - a for w, a in zip(whole, left))]
                    children = growing[k].split(node, int(feature), int(cut), tuple(_leaf(g, h, classes) for _, g, h in sides))
                    following += [(k, child) for child, (m, _, _) in zip(children, sides) if m > 1.5]
            nodes, level = following, level + 1
        return [g.tree() for g in growing]


def _leaf(pull: float, curve: float, classes: int) -> float:
    """One Newton step for the scores of a leaf's class."""
    return float((classes - 1) / classes * pull / curve) if curve > 1e-150 else 0.0


class GradientBoostingModel(StatefulModel, ClassifierParams):
    """Predicts the class with the highest sum of its trees; classes without training rows are never predicted."""

    def __init__(self, classes=(), start=None, rounds=(), step=0.1):
        super().__init__()
        self._setDefault(keyCol="case_id")
        self.classes, self.start, self.rounds, self.step = list(classes), start, list(rounds), step

    def _state(self):
        trees = [[[column.tolist() for column in tree] for tree in trees] for trees in self.rounds]
        return [self.classes, list(self.start), trees, self.step], {}

    def _restore(self, small, table) -> None:
        self.classes, start, rounds, self.step = small
        self.start = np.array(start)
        self.rounds = [[Tree(*map(np.array, tree)) for tree in trees] for trees in rounds]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return add_trees(np.tile(self.start, (len(rows), 1)), rows, self.rounds, self.step)

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((np.array(self.classes), self.start, self.rounds, self.step))

        def predict(block: np.ndarray) -> np.ndarray:
            classes, start, rounds, step = shared.value
            return classes[add_trees(np.tile(start, (len(block), 1)), block, rounds, step).argmax(axis=1)]

        return df.withColumn(self.getPredictionCol(), block_score(F.col(self.getFeaturesCol()), predict))
