"""Exact nearest neighbours as a partitioned block join, and the voting classifier.

Training rows are cut into cells around pivots, and near cells are put together until they fill a task. A query is sent
only to the groups of cells that can hold one of its neighbours, by bounds from the triangle inequality; each pair of a query
chunk and a group is one bounded task that returns the best ``k`` of the group, and the partial results are merged. No
pair of rows leaves a task, and a crowded cell is split.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf

from casemill.operators.stages import (
    ClassifierParams,
    DefaultParamsReadable,
    DefaultParamsWritable,
    Estimator,
    StatefulModel,
    keyword_only,
    param,
)
from casemill.operators.vectors import as_block, block_score, width_of
from casemill.session import write_through

# A training table of at most this many numbers (16 MB) is broadcast.
BROADCAST_NUMBERS = 2_000_000
BLOCK_ROWS = 4096
MAX_PIVOTS = 2048
# Numbers of the training rows, and of the queries, that one task compares with each other (32 MB each).
TASK_NUMBERS = 4_000_000
# Queries of a task are not cut below this many rows to keep all cores busy.
LEAST_QUERIES = 4096
# Training rows for each of the tasks over which queries are dealt before they search a broadcast table.
SCAN_ROWS = 2000
# Candidates beyond k whose distances are taken exactly without a look at how many are as near.
SPARE = 8
# Columns of which only the least value is looked at first.
STRIDE = 16
# The rough pass compares so many queries with so many training rows at a time, and keeps the least value of each ``LANE`` rows.
TILE_QUERIES, TILE_ROWS, LANE = 256, 2048, 8
# Numbers of the differences that are held at a time (16 MB), and a bound of the relative error of one product of the rough pass.
EXACT_NUMBERS, ROUNDING = 2_000_000, 6e-8


def smallest(values: np.ndarray, many: int) -> np.ndarray:
    """Places of the ``many`` least values of each row: they are in the ``many`` strides with the least minima."""
    rows, n = values.shape
    if n <= many:
        return np.arange(n)[None, :].repeat(rows, 0)
    width = n // STRIDE
    if width < 4 * many:
        return np.argpartition(values, many - 1, axis=1)[:, :many]
    least = values[:, : STRIDE * width].reshape(rows, STRIDE, width).min(axis=1)
    best = np.argpartition(least, many - 1, axis=1)[:, :many]
    inside = (best[:, None, :] + width * np.arange(STRIDE)[None, :, None]).reshape(rows, -1)
    some = np.concatenate([inside, np.arange(STRIDE * width, n)[None, :].repeat(rows, 0)], axis=1)
    chosen = np.argpartition(np.take_along_axis(values, some, 1), many - 1, axis=1)[:, :many]
    return np.take_along_axis(some, chosen, 1)


def nearest(queries: np.ndarray, train: np.ndarray, train_ids: np.ndarray, k: int, own_ids=None):
    """Positions (q, k) and squared distances of the nearest rows, ties by ``train_ids``. Missing places are -1."""
    return Search(train, train_ids, [(train.shape[1] if len(train) else 0, k)]).nearest(queries, own_ids)[0]


class Search:
    """The ``k`` nearest of some training rows by their leading ``n`` columns, for each ``(n, k)`` wanted, ``n`` ascending.

    Products in single precision go through all rows once, from fewer columns to more, and leave the least value of every
    few rows. Those of the rows that may be among the nearest, with a margin for the rounding, are then compared by their
    differences in double precision, as ``scanned`` does. Queries with very many such rows are left to ``scanned``.
    """

    def __init__(self, train: np.ndarray, train_ids: np.ndarray, wanted: list[tuple[int, int]]):
        self.train, self.ids, self.wanted = train, train_ids, wanted
        self.rough = min(k for _, k in wanted) > 0 and len(train) >= 4 * LANE * max(k for _, k in wanted)
        if not self.rough:
            return
        self.mean = train.mean(axis=0)
        rows = train - self.mean
        self.width = min(TILE_ROWS, -(-len(train) // LANE) * LANE) // LANE  # groups of a tile
        size = LANE * self.width
        self.parts, self.norms, start, total = [], [], 0, np.zeros(len(train))
        with np.errstate(over="ignore", invalid="ignore"):
            for n, _ in wanted:
                part = rows[:, start:n]
                square = np.einsum("ij,ij->i", part, part)
                total = total + square
                self.norms.append(total.max())
                held = np.zeros((part.shape[1] + 1, -(-len(train) // size) * size), np.float32)
                held[:-1, : len(train)] = part.T
                held[-1] = np.inf  # places without a row are never near
                held[-1, : len(train)] = square
                self.parts.append((start, n, [np.ascontiguousarray(held[:, i : i + size]) for i in range(0, held.shape[1], size)]))
                start = n

    def nearest(self, queries: np.ndarray, own_ids=None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each ``(n, k)``: places (q, k) and squared distances, ties by id; missing places are -1."""
        parts = []
        extra = np.zeros(len(queries), np.int64)
        if own_ids is not None:
            sorted_ids = np.sort(self.ids)
            extra = np.searchsorted(sorted_ids, own_ids, side="right") - np.searchsorted(sorted_ids, own_ids, side="left")
        for start in range(0, len(queries) if self.rough else 0, TILE_QUERIES):
            at = slice(start, start + TILE_QUERIES)
            parts.append(self._tile(queries[at], None if own_ids is None else own_ids[at], extra[at]))
        if not self.rough or not parts:
            return [scanned(queries[:, :n], np.ascontiguousarray(self.train[:, :n]), self.ids, k, own_ids) for n, k in self.wanted]
        found = []
        for i, (n, k) in enumerate(self.wanted):
            places, away, left = (np.concatenate([p[i][j] for p in parts]) for j in range(3))
            if left.any():
                own = None if own_ids is None else own_ids[left]
                places[left], away[left] = scanned(queries[left, :n], np.ascontiguousarray(self.train[:, :n]), self.ids, k, own)
            found.append((places, away))
        return found

    def _tile(self, queries: np.ndarray, own_ids, extra: np.ndarray) -> list[tuple]:
        """Places, squared distances, and which queries are left to ``scanned``."""
        centred = queries - self.mean
        many, tiles = len(queries), len(self.parts[0][2])
        least = [np.empty((many, tiles * self.width), np.float32) for _ in self.wanted]
        out, with_one = np.empty((many, LANE * self.width), np.float32), []
        with np.errstate(over="ignore", invalid="ignore"):
            for start, n, _ in self.parts:
                with_one.append(np.column_stack([-2.0 * centred[:, start:n], np.ones(many)]).astype(np.float32))
            for t in range(tiles):
                total = None
                for i, (left, (_, _, held)) in enumerate(zip(with_one, self.parts)):
                    if total is None:
                        total = np.matmul(left, held[t], out=out)
                    else:
                        total += left @ held[t]
                    np.min(total.reshape(many, LANE, self.width), axis=1, out=least[i][:, t * self.width : (t + 1) * self.width])
            return [self._exact(i, queries, centred, least[i], own_ids, extra) for i in range(len(self.wanted))]

    def _exact(self, i: int, queries, centred, least, own_ids, extra) -> tuple:
        n, k = self.wanted[i]
        many, wide = len(queries), k + int(extra.max(initial=0))
        own = np.einsum("ij,ij->i", centred[:, :n], centred[:, :n])
        margin = 2.0 * (n + 16) * ROUNDING * (own + 2.0 * self.norms[i])
        # As many values as are wanted are at most as large as the limit.
        few = least
        if least.shape[1] // STRIDE >= 4 * wide:
            few = least[:, : least.shape[1] // STRIDE * STRIDE].reshape(many, STRIDE, -1).min(axis=1)
        if few.shape[1] < wide:
            limit = np.full(many, np.inf)
        else:
            limit = np.partition(few, wide - 1, axis=1)[:, wide - 1].astype(np.float64) + margin
        near = least <= limit[:, None]
        counts = near.sum(axis=1)
        left = ~(np.isfinite(limit) & (counts <= 8 * wide + 64))
        near[left] = False
        rows, groups = np.nonzero(near)
        values = least[rows, groups]
        # The same with the value that the k-th of these groups has.
        order = np.lexsort((values, rows))
        counts = np.bincount(rows, minlength=many)
        ends = counts.cumsum()
        kth = np.where(counts >= wide, ends - counts + wide - 1, 0)
        if len(rows):
            tighter = np.where(counts >= wide, values[order][kth] + margin, np.inf)
            inside = values <= tighter[rows]
            rows, groups = rows[inside], groups[inside]
        tile, lane = np.divmod(groups, self.width)
        places = ((tile * LANE * self.width + lane)[:, None] + self.width * np.arange(LANE)).ravel()
        rows = np.repeat(rows, LANE)
        real = places < len(self.train)
        rows, places = rows[real], places[real]
        if own_ids is not None:
            other = self.ids[places] != own_ids[rows]
            rows, places = rows[other], places[other]
        exact, asked, train = np.empty(len(rows)), queries[:, :n], self.train[:, :n]
        step = max(1, EXACT_NUMBERS // max(n, 1))
        for start in range(0, len(rows), step):
            at = slice(start, start + step)
            difference = train[places[at]] - asked[rows[at]]
            exact[at] = np.einsum("ij,ij->i", difference, difference)
        order = np.lexsort((self.ids[places], exact, rows))
        counts = np.bincount(rows, minlength=many)
        rows, places, exact = rows[order], places[order], exact[order]
        rank = np.arange(len(rows)) - np.repeat(counts.cumsum() - counts, counts)
        first = rank < k
        found, away = np.full((many, k), -1, dtype=np.int64), np.full((many, k), np.inf)
        found[rows[first], rank[first]] = places[first]
        away[rows[first], rank[first]] = exact[first]
        return found, away, left


def scanned(queries: np.ndarray, train: np.ndarray, train_ids: np.ndarray, k: int, own_ids=None):
    """The same in double precision, by all products.

    A product finds candidates, with a margin for its rounding; their distances are then taken
    from differences, so that equal distances compare equal. Missing places are -1.
    """
    k = min(k, len(train))
    places = np.full((len(queries), k), -1, dtype=np.int64)
    found = np.full((len(queries), k), np.inf)
    if k == 0:
        return places, found
    norms = np.einsum("ij,ij->i", train, train)
    turned = np.ascontiguousarray(np.column_stack([train, norms]).T)
    if own_ids is not None:
        by_id = np.argsort(train_ids, kind="stable")
        sorted_ids = train_ids[by_id]
    step = max(1, min(4_000_000 // len(train), 4_000_000 // ((k + SPARE) * max(train.shape[1], 1))))
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        own = np.einsum("ij,ij->i", part, part)
        # Squared distances less the query's own square.
        rough = np.column_stack([-2.0 * part, np.ones(len(part))]) @ turned
        if own_ids is not None:
            first, end = (np.searchsorted(sorted_ids, own_ids[start : start + step], side=s) for s in ("left", "right"))
            many = end - first
            at = np.arange(many.sum()) + np.repeat(first - (many.cumsum() - many), many)
            rough[np.repeat(np.arange(len(part)), many), by_id[at]] = np.inf
        margin = 1e-9 * (1.0 + own + norms.max())
        # Some more than k candidates: mostly these are all rows within the margin of the k-th one.
        wide = min(len(train), k + SPARE)
        some = smallest(rough, wide)
        close = np.take_along_axis(rough, some, 1)
        limit = np.partition(close, k - 1, axis=1)[:, k - 1] + margin
        difference = train[some] - part[:, None, :]
        exact = np.einsum("ijk,ijk->ij", difference, difference)
        exact[(close > limit[:, None]) | np.isinf(close)] = np.inf
        order = np.argsort(train_ids[some], axis=1, kind="stable")
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(exact, order, 1), axis=1, kind="stable"), 1)[:, :k]
        best = np.take_along_axis(exact, order, 1)
        places[start : start + len(part)] = np.where(np.isinf(best), -1, np.take_along_axis(some, order, 1))
        found[start : start + len(part)] = best
        if wide == len(train):
            continue
        for i in np.flatnonzero(close.max(axis=1) <= limit):  # more rows are as near
            near = np.flatnonzero((rough[i] <= limit[i]) & np.isfinite(rough[i]))
            difference = train[near] - part[i]
            exact = np.einsum("ij,ij->i", difference, difference)
            order = np.lexsort((train_ids[near], exact))[:k]
            places[start + i] = -1
            found[start + i] = np.inf
            places[start + i, : len(order)] = near[order]
            found[start + i, : len(order)] = exact[order]
    return places, found


def vote(labels: np.ndarray) -> np.ndarray:
    """The most frequent label of each row, the smallest one on ties."""
    ordered = np.sort(labels, axis=1)
    best, most = ordered[:, 0].copy(), np.zeros(len(ordered), np.int64)
    run = np.zeros(len(ordered), np.int64)
    for j in range(ordered.shape[1]):
        run = np.where(ordered[:, j] == ordered[:, j - 1], run + 1, 1) if j else run + 1
        more = run > most
        best[more], most[more] = ordered[more, j], run[more]
    return best


def _stack(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def pivot_distances(block: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (block**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * block @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def candidate_cells(block, pivots, counts, low, high, k) -> list[np.ndarray]:
    """For each query the cells that can hold one of its ``k`` nearest rows.

    ``counts``, ``low`` and ``high`` give each cell's rows and its range of distances to the
    pivot. The k-th neighbour is at most as far as the first cells, by far end, that hold k
    rows; a cell is left out when its near end is farther than that.
    """
    to = pivot_distances(block, pivots)
    far = to + high[None, :]
    order = np.argsort(far, axis=1, kind="stable")
    held = np.cumsum(counts[order], axis=1)
    enough = np.argmax(held >= k, axis=1)
    limit = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
    limit[held[:, -1] < k] = np.inf
    near = np.maximum(to - high[None, :], low[None, :] - to)
    between = pivot_distances(pivots, pivots)
    home = to.argmin(1)
    gap = between[home]
    own = to[np.arange(len(to)), home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(gap > 0, (to**2 - own[:, None] ** 2) / (2 * gap), 0.0)
    near = np.maximum(near, plane)
    slack = 1e-6 * (1.0 + limit[:, None] + to)
    keep = (near <= limit[:, None] + slack) & (counts[None, :] > 0)
    return [np.flatnonzero(row) for row in keep]


def task_groups(pivots: np.ndarray, counts: np.ndarray, rows: int) -> np.ndarray:
    """Group of each part and cell, from the rows in them; -1 where there are none.

    A group is what a task compares queries with: near cells of one part with at most ``rows`` rows, or some small
    parts. Only a single cell may have more.
    """
    group, many, shared, held = np.full(counts.shape, -1), 0, -1, 0
    for part, inside in enumerate(counts):
        cells = np.flatnonzero(inside)
        if not len(cells):
            continue
        if 2 * inside.sum() <= rows:
            if shared < 0 or held + inside.sum() > rows:
                shared, held, many = many, 0, many + 1
            group[part, cells] = shared
            held += inside.sum()
            continue
        open_sets = [cells]
        while open_sets:
            cells = open_sets.pop()
            if len(cells) == 1 or inside[cells].sum() <= rows:
                group[part, cells], many = many, many + 1
                continue
            order = cells[np.argsort(pivots[cells, pivots[cells].var(axis=0).argmax()], kind="stable")]
            before = inside[order].cumsum()
            cut = min(max(1, int(np.searchsorted(before, before[-1] / 2))), len(order) - 1)
            open_sets += [order[:cut], order[cut:]]
    return group


def block_join(
    queries: DataFrame, train: DataFrame, n: int, d: int, k: int, exclude_self: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``key, part, near``: rows with, for each query and each ``part`` of ``train``, the ``k`` nearest rows of the part among them.

    A part that fills several tasks gives a row for each (see ``merged``). ``queries`` have ``key, vector``, the ``n`` rows of ``train`` of ``d`` numbers also an int ``part`` and a double ``label``;
    ``near`` has entries of ``distance2, neighbor, label``. A query is sent once to each group of cells that can hold one of its
    neighbours, so what is shuffled depends on the rows that fit into a task and not on the size of the cells.
    """
    spark = queries.sparkSession
    # Both may come from one table: the columns of the sides get names of their own.
    queries = queries.select(F.col("key").alias("key"), F.col("vector").alias("vector"))
    # Pivots: a fixed pseudo-random choice, at most MAX_PIVOTS rows on the driver.
    wanted = min(MAX_PIVOTS, -(-n // block_rows))
    chosen = train.orderBy(F.xxhash64("key"), "key").limit(wanted).select("vector").toArrow()
    pivots = np.unique(as_block(chosen["vector"].combine_chunks()), axis=0)
    pivot_data = spark.sparkContext.broadcast(pivots)

    def nearest_pivot(vectors: pa.Array) -> pa.Array:
        to = pivot_distances(as_block(vectors), pivot_data.value)
        home = to.argmin(1)
        parts = [pa.array(home.astype(np.int32)), pa.array(to[np.arange(len(to)), home])]
        return pa.StructArray.from_arrays(parts, ["cell", "away"])

    homes = train.withColumn("_home", arrow_udf(nearest_pivot, "cell int, away double")("vector"))
    homes = homes.select("key", "vector", "part", "label", "_home.cell", "_home.away")
    stats = homes.groupBy("part", "cell").agg(
        F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")
    ).collect()
    shape = max(r["part"] for r in stats) + 1, len(pivots)
    counts, low, high = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
    for r in stats:
        at = r["part"], r["cell"]
        counts[at], low[at], high[at] = r["n"], r["lo"], r["hi"]
    most = max(1, TASK_NUMBERS // d)
    groups = task_groups(pivots, counts, most)
    bounds = spark.sparkContext.broadcast((counts, low, high, groups))
    reach = k + 1 if exclude_self else k

    def route(vectors: pa.Array) -> pa.Array:
        block, (counts, low, high, groups) = as_block(vectors), bounds.value
        sent = np.zeros((len(block), groups.max() + 1), bool)
        for part in np.flatnonzero(counts.any(axis=1)):
            used = np.unique(groups[part][groups[part] >= 0])
            if len(used) == 1:  # the part has a neighbour for every query
                sent[:, used[0]] = True
                continue
            for start in range(0, len(block), 1024):
                rows = block[start : start + 1024]
                cells = candidate_cells(rows, pivot_data.value, counts[part], low[part], high[part], reach)
                for i, c in enumerate(cells, start):
                    sent[i, groups[part][c]] = True
        ends = np.concatenate([[0], sent.sum(axis=1).cumsum()]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(sent)[1].astype(np.int32)))

    routed = queries.withColumn("cell", F.explode(arrow_udf(route, "array<int>")("vector")))
    load = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    rows = {g: int(counts[groups == g].sum()) for g in load}
    # One row per group: into how many blocks its rows and into how many chunks its queries go.
    size = min(most, max(LEAST_QUERIES, sum(load.values()) // spark.sparkContext.defaultParallelism + 1))
    cut = [(g, max(1, -(-rows[g] // most)), -(-m // size)) for g, m in load.items()]
    plan = F.broadcast(spark.createDataFrame(cut, "cell int, blocks int, chunks int"))
    left = routed.join(plan, "cell").select(
        "key",
        "vector",
        "cell",
        F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    places = spark.createDataFrame(
        [(int(p), int(c), int(groups[p, c])) for p, c in np.argwhere(groups >= 0)], "part int, _cell int, cell int"
    )
    right = homes.withColumnRenamed("cell", "_cell").join(F.broadcast(places), ["part", "_cell"]).join(plan, "cell").select(
        "key",
        "vector",
        "part",
        "label",
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"),
    )
    schema = "key long, part int, distance2 array<double>, neighbor array<long>, label array<double>"
    names = ["key", "part", "distance2", "neighbor", "label"]

    def pair(q: pa.Table, t: pa.Table) -> pa.Table:
        found = []
        if q.num_rows and t.num_rows:
            ids, asked = q["key"].to_numpy(), as_block(q["vector"].combine_chunks())
            parts, block = t["part"].to_numpy(), as_block(t["vector"].combine_chunks())
            train_ids, labels = t["key"].to_numpy(), t["label"].to_numpy()
            for part in np.unique(parts):
                at = np.flatnonzero(parts == part)
                places, away = nearest(asked, block[at], train_ids[at], k, ids if exclude_self else None)
                good = places >= 0
                ends = pa.array(np.concatenate([[0], good.sum(axis=1).cumsum()]).astype(np.int32))
                values = away[good], train_ids[at][places[good]], labels[at][places[good]]
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]
                found.append(pa.table([pa.array(ids), pa.array(np.full(len(ids), part, np.int32)), *lists], names))
        if found:
            return pa.concat_tables(found)
        kinds = [pa.int64(), pa.int32(), *map(pa.list_, (pa.float64(), pa.int64(), pa.float64()))]
        return pa.table([pa.array([], kind) for kind in kinds], names)

    by = ["cell", "block", "chunk"]
    # As many partitions as tasks, which are few and long: small inputs are not put together.
    tasks = min(2000, 2 * sum(b * c for _, b, c in cut) + 1)
    left, right = (side.repartition(tasks, *by) for side in (left, right))
    partial = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(pair, schema)
    return partial.select("key", "part", F.arrays_zip("distance2", "neighbor", "label").alias("near"))


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One row per query and part of ``block_join``, nearest first: at most ``k`` entries of each task come together."""
    near = F.array_sort(F.flatten(F.collect_list("near")))
    return lists.groupBy("key", "part").agg(F.slice(near, 1, k).alias("near"))


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    key: str = "key",
    vector: str = "vector",
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    broadcast_numbers: int | None = None,
) -> DataFrame:
    """``key, neighbor, distance2``: the ``k`` nearest training rows of every query row.

    Both inputs have a long ``key`` and an ``array<double>`` column ``vector``; ties go to the
    smaller training key. Train keys must be unique.
    """
    spark = queries.sparkSession
    size = train.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    n, d = size["n"], size["d"] or 1
    schema = "key long, neighbor long, distance2 double"
    queries = queries.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    train = train.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    if n == 0:
        return spark.createDataFrame([], schema)

    if n * d <= (BROADCAST_NUMBERS if broadcast_numbers is None else broadcast_numbers):
        rows = train.toArrow()
        held = spark.sparkContext.broadcast(
            (rows["key"].to_numpy(), as_block(rows["vector"].combine_chunks()))
        )

        def scan(batches):
            train_ids, block = held.value
            search = Search(block, train_ids, [(block.shape[1], k)])
            for batch in batches:
                if len(batch):
                    ids = batch["key"].to_numpy()
                    own = ids if exclude_self else None
                    ((places, found),) = search.nearest(_stack(batch["vector"]), own)
                    good = places >= 0
                    yield pd.DataFrame(
                        {"key": np.repeat(ids, good.sum(1)), "neighbor": train_ids[places[good]], "distance2": found[good]}
                    )

        # Tables are read in few partitions, however long the search of a row takes.
        tasks = min(spark.sparkContext.defaultParallelism, n // SCAN_ROWS + 1)
        return (queries.repartition(tasks) if tasks > 1 else queries).mapInPandas(scan, schema)

    whole = train.withColumns({"part": F.lit(0), "label": F.lit(0.0)})
    near = merged(block_join(queries, whole, n, d, k, exclude_self, block_rows), k)
    return near.select("key", F.inline("near")).select("key", "neighbor", "distance2")


class KNeighbors(Estimator, ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Majority of the ``k`` nearest training rows, the smallest label on ties."""

    k = param("k", "number of neighbours", "int")

    @keyword_only
    def __init__(self, k=5, featuresCol="features", labelCol="label", predictionCol="prediction", keyCol="case_id"):
        super().__init__()
        self._setDefault(k=5, keyCol="case_id")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> KNeighborsModel:
        train = df.select(
            F.col(self.getOrDefault("keyCol")).cast("long").alias("key"),
            vector_to_array(self.getFeaturesCol()).alias("vector"),
            F.col(self.getLabelCol()).cast("double").alias("label"),
        )
        order = ["key", "label", "vector"]
        d = width_of(df, self.getFeaturesCol())
        model = KNeighborsModel()
        # In both forms a row is named by its place in the order of key and label, so repeated or
        # missing keys are rows like others and ties go the same way.
        if df.count() * d <= BROADCAST_NUMBERS:
            rows = train.toArrow()
            rows = rows.take(pc.sort_indices(rows.select(["key", "label"]), [("key", "ascending"), ("label", "ascending")], null_placement="at_start"))
            model.small = (
                np.arange(rows.num_rows),
                as_block(rows["vector"].combine_chunks()),
                rows["label"].to_numpy(),
            )
        else:
            ordered = train.orderBy(*order).withColumn("key", F.monotonically_increasing_id())
            model.table = write_through(ordered)
        return self._copyValues(model)


class KNeighborsModel(StatefulModel, ClassifierParams):
    """Holds the training rows: as arrays while they are small, as a table otherwise."""

    k = param("k", "number of neighbours", "int")

    def __init__(self):
        super().__init__()
        self._setDefault(k=5, keyCol="case_id")
        self.small = None
        self.table = None

    def _state(self):
        if self.small is None:
            return {}, {"train": self.table}
        keys, block, labels = self.small
        return {"keys": keys.tolist(), "block": block.tolist(), "labels": labels.tolist()}, {}

    def _restore(self, small, table) -> None:
        if small:
            self.small = (np.array(small["keys"]), np.array(small["block"]), np.array(small["labels"]))
        else:
            self.table = table("train")

    def _transform(self, df: DataFrame) -> DataFrame:
        k = self.getOrDefault("k")
        if self.small is not None:
            held = df.sparkSession.sparkContext.broadcast(self.small)

            def predict(block: np.ndarray) -> np.ndarray:
                keys, train, labels = held.value
                places, _ = nearest(block, train, keys, k)
                return vote(labels[places])

            return df.withColumn(self.getPredictionCol(), block_score(F.col(self.getFeaturesCol()), predict))
        numbered = write_through(df.withColumn("_row", F.monotonically_increasing_id()))
        queries = numbered.select(
            F.col("_row").alias("key"), vector_to_array(self.getFeaturesCol()).alias("vector")
        )
        pairs = knn_join(queries, self.table.select("key", "vector"), k)
        labels = self.table.select(F.col("key").alias("neighbor"), F.col("label").alias("_label"))
        votes = pairs.join(labels, "neighbor").groupBy("key", "_label").agg(F.count("*").alias("_n"))
        winner = F.max_by("_label", F.struct(F.col("_n"), -F.col("_label")))
        chosen = votes.groupBy("key").agg(winner.alias(self.getPredictionCol()))
        return numbered.join(chosen.withColumnRenamed("key", "_row"), "_row", "left").drop("_row")
