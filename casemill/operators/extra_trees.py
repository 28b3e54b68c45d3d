"""Extremely randomised trees: all trees of the forest grow over the same passes.

Every open node draws columns and, for each, one random cut between the bounds that its path leaves for the column; the
cut that lowers the Gini impurity most is taken. The rows on the left of all drawn cuts of all open nodes are counted by
class in one Spark job, so the jobs depend on the depth and not on the number of trees. A node that no drawn cut divides
draws again with the next job. Draws depend on seed, tree, node and attempt only, not on partitions or the order of rows.

With more than a few rows and trees the nodes would fill the driver: each tree is then grown by a task, which holds copies of the rows,
and the forest is a table. Its rows are scored by pairs of query chunks and groups of trees. Both forms have the same trees.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from casemill.operators import boosting
from casemill.operators.boosting import Tree
from casemill.operators.stages import (
    ClassifierParams,
    DefaultParamsReadable,
    DefaultParamsWritable,
    Estimator,
    StatefulModel,
    keyword_only,
    param,
)
from casemill.operators.vectors import as_block, block_score, blocks_of, packed, summed, width_of
from casemill.session import write_through

#: Counts in one job (32 MB); more open nodes take several jobs.
NUMBERS = 4_000_000
#: Rows times trees whose nodes the driver holds.
DRIVER_ROWS = 10_000
#: Numbers of the rows that a task may hold (320 MB). Trees of larger tables grow on the driver by shared passes.
TASK_NUMBERS = 40_000_000
#: Numbers of the queries, and of their shares, that a task scores at a time (32 MB).
QUERY_NUMBERS = 4_000_000
#: A tree of the table: cuts, and the shares of classes of node ``i`` from ``first[i]`` to ``first[i + 1]``.
TABLE = {"feature": np.int32, "cut": np.float64, "left": np.int32, "first": np.int64, "label": np.int32, "share": np.float64}


def draw(seed: int, tree: int, node: int, attempt: int, low: np.ndarray, high: np.ndarray, path: tuple, columns: int):
    """The drawn columns of a node and a cut for each. ``path`` holds ``(column, goes right, cut)`` of the nodes above."""
    random = np.random.default_rng([seed, tree, node, attempt])
    chosen = random.choice(len(low), columns, replace=False)
    a, b = low[chosen].copy(), high[chosen].copy()
    place = {column: i for i, column in enumerate(chosen.tolist())}
    for column, right, cut in path:
        if column in place:  # deeper cuts are narrower
            (a if right else b)[place[column]] = cut
    return chosen, a + random.random(columns) * (b - a)


def best_of(left: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of counts ``(nodes, draws, classes)`` the draw with the least Gini impurity, and whether it divides its node."""
    right = whole[:, None, :] - left
    n, m = left.sum(2), right.sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = (left**2).sum(2) / n + (right**2).sum(2) / m
    purity[(n == 0) | (m == 0)] = -1.0
    at = purity.argmax(axis=1)
    return at, purity[np.arange(len(at)), at] >= 0


def add_left(total, x, y, slot, columns, cuts, classes: int) -> None:
    """Add the rows by class on the left of each drawn cut of their node; ``slot`` is -1 for rows in no chosen node."""
    at = np.flatnonzero(slot >= 0)
    slot = slot[at]
    goes = x[at[:, None], columns[slot]] <= cuts[slot]
    key = (slot[:, None] * columns.shape[1] + np.arange(columns.shape[1])) * classes + y[at, None]
    np.add.at(total, key[goes], 1.0)


def grow(growing: dict, counted, seed: int, whole, low, high, columns: int, depth: int | None, attempts: int) -> None:
    """Grow trees, by their numbers; ``counted(nodes, draws)`` gives the rows by class on the left of each drawn cut."""
    grows = lambda counts, path: (counts > 0).sum() > 1 and (depth is None or len(path) < depth)
    for g in growing.values():
        g.put(0, whole)
    open_nodes = [(t, 0, (), 0) for t in growing if grows(whole, ())]
    while open_nodes:
        following, part = [], max(1, NUMBERS // (columns * len(whole)))
        for first in range(0, len(open_nodes), part):
            chosen = open_nodes[first : first + part]
            draws = [draw(seed, t, node, attempt, low, high, path, columns) for t, node, path, attempt in chosen]
            counts, totals = counted(chosen, draws), [growing[t].rows(node, len(whole)) for t, node, *_ in chosen]
            best, divides = best_of(counts, np.array(totals))
            for i, (t, node, path, attempt) in enumerate(chosen):
                if not divides[i]:
                    if attempt + 1 < attempts:
                        following.append((t, node, path, attempt + 1))
                    continue
                column, cut = int(draws[i][0][best[i]]), float(draws[i][1][best[i]])
                # Copies: a view would keep the counts of all nodes.
                sides = counts[i, best[i]].copy(), totals[i] - counts[i, best[i]]
                for right, child in enumerate(growing[t].split(node, column, cut, sides)):
                    below = (*path, (column, bool(right), cut))
                    if grows(sides[right], below):
                        following.append((t, child, below, 0))
        open_nodes = following


class Growing(boosting.Growing):
    """A tree whose nodes have the rows of each class."""

    def put(self, node: int, counts: np.ndarray) -> None:
        self.value[node] = counts

    def rows(self, node: int, classes: int) -> np.ndarray:
        return self.value[node]


class Compact(Growing):
    """The same with the classes and rows of leaves and open nodes only."""

    def put(self, node: int, counts: np.ndarray) -> None:
        found = np.flatnonzero(counts)
        self.value[node] = found, counts[found]

    def rows(self, node: int, classes: int) -> np.ndarray:
        counts = np.zeros(classes)
        counts[self.value[node][0]] = self.value[node][1]
        return counts

    def split(self, node: int, feature: int, cut: int, values: tuple) -> list[int]:
        children = super().split(node, feature, cut, (None, None))
        for child, counts in zip(children, values):
            self.put(child, counts)
        self.value[node] = (), ()
        return children

    def table(self) -> dict:
        """The columns of ``TABLE``."""
        first = np.append(0, np.cumsum([len(found) for found, _ in self.value]))
        label = np.concatenate([found for found, _ in self.value])
        share = np.concatenate([counts / np.sum(counts) for _, counts in self.value if len(counts)])
        columns = self.feature, self.cut, self.left, first, label, share
        return {name: np.asarray(c).astype(kind).tobytes() for (name, kind), c in zip(TABLE.items(), columns)}


class Reached:
    """The rows of a task and the nodes that they have reached in a growing tree."""

    def __init__(self, growing: Growing, x: np.ndarray, y: np.ndarray, classes: int):
        self.growing, self.x, self.y, self.classes = growing, x, y, classes
        self.node = np.zeros(len(x), np.int64)

    def left(self, chosen: list, draws: list) -> np.ndarray:
        tree = self.growing.cuts()
        self.node = tree.nodes_of(self.x, self.node)
        slots = np.full(len(tree.feature), -1)
        slots[[node for _, node, *_ in chosen]] = np.arange(len(chosen))
        columns, cuts = (np.array([d[i] for d in draws]) for i in range(2))
        total = np.zeros(columns.size * self.classes)
        add_left(total, self.x, self.y, slots[self.node], columns, cuts, self.classes)
        return total.reshape(*columns.shape, self.classes)


class ExtraTrees(Estimator, ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """A forest with random cuts on all rows. ``depth`` None is no bound; ``attempts`` draws leave a node undivided."""

    trees = param("trees", "number of trees", "int")
    depth = param("depth", "levels of cuts in a tree; None is no bound")
    attempts = param("attempts", "draws after which a node that none of them divides stays a leaf", "int")

    @keyword_only
    def __init__(
        self, trees=100, depth=None, attempts=20, seed=0,
        featuresCol="features", labelCol="label", predictionCol="prediction",
    ):
        super().__init__()
        self._setDefault(trees=100, depth=None, attempts=20, seed=0, keyCol="case_id")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ExtraTreesModel:
        features, label = self.getFeaturesCol(), F.col(self.getLabelCol()).cast("int")
        many, depth, attempts, seed = (self.getOrDefault(n) for n in ("trees", "depth", "attempts", "seed"))
        rows = {r["y"]: r["n"] for r in df.groupBy(label.alias("y")).agg(F.count("*").alias("n")).collect()}
        if not rows:
            raise ValueError("no rows to fit on")
        classes = np.array(sorted(rows))
        whole = np.array([rows[c] for c in classes.tolist()], float)
        bounds = df.select(Summarizer.metrics("min", "max").summary(F.col(features)).alias("s")).first()["s"]
        low, high = bounds["min"].toArray(), bounds["max"].toArray()
        columns = math.isqrt(len(low)) or 1
        numbers = sum(rows.values()) * len(low)
        if sum(rows.values()) * many > DRIVER_ROWS and numbers <= TASK_NUMBERS:
            settings = seed, whole, low, high, columns, depth, attempts
            table = self._in_tasks(packed(df, features, label), many, classes, settings)
            return self._copyValues(ExtraTreesModel(classes.tolist(), table=table, many=many))
        growing = {t: Growing() for t in range(many)}
        blocks = packed(df, features, label).persist()
        try:
            blocks.count()
            partitions = blocks.rdd.getNumPartitions()
            counted = lambda chosen, draws: self._counts(blocks, partitions, growing, chosen, draws, classes)
            grow(growing, counted, seed, whole, low, high, columns, depth, attempts)
        finally:
            blocks.unpersist()
        trees = (g.tree() for g in growing.values())
        made = [tree._replace(value=tree.value / tree.value.sum(1, keepdims=True)) for tree in trees]
        return self._copyValues(ExtraTreesModel(classes.tolist(), made))

    @staticmethod
    def _in_tasks(blocks: DataFrame, many: int, classes: np.ndarray, settings: tuple) -> DataFrame:
        """A table with a row for each tree. A task has all rows and every ``groups``-th tree."""
        groups = min(many, blocks.sparkSession.sparkContext.defaultParallelism)

        def grown(held: pa.Table) -> pa.Table:
            parts = list(blocks_of(held.to_batches()))
            x = np.concatenate([p[0] for p in parts])
            y = np.searchsorted(classes, np.concatenate([p[1] for p in parts]))
            made = []
            for t in range(held["group"][0].as_py(), many, groups):
                tree = {t: Compact()}
                grow(tree, Reached(tree[t], x, y, len(classes)).left, *settings)
                made.append({"tree": t, **tree[t].table()})
            fields = [pa.field("tree", pa.int32()), *(pa.field(name, pa.binary()) for name in TABLE)]
            return pa.Table.from_pylist(made, pa.schema(fields))

        copies = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        schema = ", ".join(["tree int", *(f"{name} binary" for name in TABLE)])
        return write_through(copies.repartitionByRange(groups, "group").groupBy("group").applyInArrow(grown, schema))

    @staticmethod
    def _counts(blocks, partitions, growing, chosen, draws, classes) -> np.ndarray:
        """Rows by class on the left of each drawn cut of each chosen node."""
        shape = len(chosen), len(draws[0][0]), len(classes)
        places = [(t, node) for t, node, *_ in chosen]
        used = {t: growing[t].cuts() for t in {t for t, _ in places}}
        columns, cuts = (np.array([d[i] for d in draws]) for i in range(2))
        shared = blocks.sparkSession.sparkContext.broadcast((used, places, columns, cuts, classes))

        def left(parts):
            trees, places, columns, cuts, classes = shared.value
            slots = {t: np.full(len(tree.feature), -1) for t, tree in trees.items()}
            for slot, (t, node) in enumerate(places):
                slots[t][node] = slot
            total = None
            for x, labels in parts:
                total = np.zeros(math.prod(shape)) if total is None else total
                y = np.searchsorted(classes, labels)
                for t, tree in trees.items():
                    add_left(total, x, y, slots[t][tree.nodes_of(x)], columns, cuts, shape[2])
            return total

        found = summed(blocks, left, math.prod(shape), partitions).reshape(shape)
        shared.unpersist()
        return found


class ExtraTreesModel(StatefulModel, ClassifierParams):
    """Predicts the class with the highest mean share in the leaves of a row, the smallest one on ties."""

    def __init__(self, classes=(), trees=(), table: DataFrame | None = None, many: int = 0):
        super().__init__()
        self._setDefault(keyCol="case_id")
        self.classes, self.trees, self.table, self.many = list(classes), list(trees), table, many

    def _state(self):
        if self.table is not None:
            return [self.classes, self.many], {"trees": self.table}
        return [self.classes, [[column.tolist() for column in tree] for tree in self.trees]], {}

    def _restore(self, small, table) -> None:
        self.classes = small[0]
        if isinstance(small[1], int):
            self.many, self.table = small[1], table("trees")
        else:
            self.trees = [Tree(*map(np.array, tree)) for tree in small[1]]

    def chances(self, rows: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return shares_of(self.table.toArrow(), rows, len(self.classes)) / self.many
        return _chances(self.trees, rows)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.table is not None:
            return self._by_groups(df)
        shared = df.sparkSession.sparkContext.broadcast((np.array(self.classes), self.trees))

        def predict(block: np.ndarray) -> np.ndarray:
            classes, trees = shared.value
            return classes[_chances(trees, block).round(12).argmax(axis=1)]

        return df.withColumn(self.getPredictionCol(), block_score(F.col(self.getFeaturesCol()), predict))

    def _by_groups(self, df: DataFrame) -> DataFrame:
        """The forest is too large for a task: every chunk of rows meets every group of trees, and the shares are added up."""
        classes, many, features = np.array(self.classes, float), self.many, self.getFeaturesCol()
        numbered = write_through(df.withColumn("_row", F.monotonically_increasing_id()))
        rows = numbered.count()
        if not rows:
            return df.withColumn(self.getPredictionCol(), F.lit(None).cast("double"))
        chunks = -(-rows * (width_of(numbered, features) + len(classes)) // QUERY_NUMBERS)
        groups = min(many, df.sparkSession.sparkContext.defaultParallelism)
        every = lambda end: F.explode(F.sequence(F.lit(0), F.lit(end - 1)))
        chunk = F.pmod(F.xxhash64("_row"), F.lit(chunks)).cast("int").alias("chunk")
        asked = numbered.select("_row", vector_to_array(features).alias("x"), chunk, every(groups).alias("group"))
        trees = self.table.withColumn("group", F.col("tree") % groups).withColumn("chunk", every(chunks))
        names = ["chunk", "rows", "shares"]

        def score(q: pa.Table, t: pa.Table) -> pa.Table:
            if not q.num_rows:
                return pa.table([pa.array([], k) for k in (pa.int32(), pa.binary(), pa.binary())], names)
            q = q.sort_by("_row")
            shares = shares_of(t, as_block(q["x"].combine_chunks()), len(classes))
            parts = q["_row"].to_numpy().tobytes(), shares.tobytes()
            return pa.table([q["chunk"][:1].combine_chunks(), *(pa.array([p], pa.binary()) for p in parts)], names)

        def decide(parts: pa.Table) -> pa.Table:
            shares = sum(np.frombuffer(s.as_py()) for s in parts["shares"]).reshape(-1, len(classes)) / many
            found = classes[shares.round(12).argmax(axis=1)]
            return pa.table([pa.array(np.frombuffer(parts["rows"][0].as_py(), np.int64)), pa.array(found)], ["_row", "_found"])

        by, tasks = ["chunk", "group"], min(2000, 2 * chunks * groups + 1)
        asked, trees = (side.repartition(tasks, *by) for side in (asked, trees))
        parts = asked.groupBy(*by).cogroup(trees.groupBy(*by)).applyInArrow(score, "chunk int, rows binary, shares binary")
        found = parts.groupBy("chunk").applyInArrow(decide, "_row long, _found double")
        joined = numbered.join(found, "_row", "left")
        return joined.withColumn(self.getPredictionCol(), F.col("_found")).drop("_row", "_found")


def shares_of(table: pa.Table, rows: np.ndarray, classes: int) -> np.ndarray:
    """Sum of the class shares in the leaves of the rows over the trees of a table."""
    total = np.zeros((len(rows), classes))
    for entry in table.sort_by("tree").to_pylist():
        feature, cut, left, first, label, share = (np.frombuffer(entry[name], kind) for name, kind in TABLE.items())
        leaf = Tree(feature, cut, left, None).nodes_of(rows)
        many = first[leaf + 1] - first[leaf]
        at = np.arange(many.sum()) + np.repeat(first[leaf] - (many.cumsum() - many), many)
        total[np.repeat(np.arange(len(rows)), many), label[at]] += share[at]
    return total


def _chances(trees: list[Tree], rows: np.ndarray) -> np.ndarray:
    return sum(tree.value[tree.nodes_of(rows)] for tree in trees) / len(trees)
