"""Exact nearest neighbours of points in a few dimensions, without a cross join.

Equal points are one point with a weight, so copies cost nothing. Known points are put in order along a Hilbert curve and
cut into boxes of about BOX_POINTS; FANOUT boxes in a row make a box of the next level, level by level, until FANOUT or
fewer are left for the driver. A box is the tight bounds of what it holds, so its size never grows with the table.

Asked points in a row along their curve form cells. A cell goes down the levels to one box near it, which gives an upper
bound of the k-th distance of each of its points, and its bounds go down again to every box within the largest of them.
So only bounds travel through the levels. Points move twice: to their bound, and as blocks of cells to the points of all
boxes that the cells come near, where numpy finds the k best leaf by leaf. A block with more than BOXES_PER_GROUP boxes
is searched in several groups and their results are ranked. The result is one row of arrays for each point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BinaryType

from flatwork.functions.coerce import num
from flatwork.operators.ordered import with_position
from flatwork.operators.quantiles import quantiles
from flatwork.sources.checkpoints import cut_lineage, stored_columns

BOX_POINTS = 500
FANOUT = 1_000
#: Asked points that a group holds, and cells.
ASKED_PER_GROUP = 32_768
CELLS_PER_GROUP = 5_000
CELL_POINTS = 128
#: Boxes whose points a group holds: in a row for the first bound, and near a block of cells.
UNIT_BOXES = 64
BOXES_PER_GROUP = 400
#: Points in a row that are compared at once.
LEAF_POINTS = 64
#: Rows and entries of one numpy call.
BATCH = 256
ENTRIES = 1 << 21
#: Allowance for rounding where distances are compared.
SLACK = 1 + 1e-12


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median of each column, 0 for an empty one: one number per column."""
    row = quantiles(df.select(*[num(df, c).alias(c) for c in columns]), list(columns), [0.5]).first()
    return {c: (row[f"q_{c}"][0] if row[f"q_{c}"] and row[f"q_{c}"][0] is not None else 0.0) for c in columns}


def filled_columns(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Each column as a number, missing as its median."""
    middle = medians(df, columns)
    return [F.coalesce(num(df, c), F.lit(float(middle[c]))) for c in columns]


def with_standardised(df: DataFrame, columns: Sequence[str], out: str = "__x") -> DataFrame:
    """Add the array of z-scores (population spread; a constant column becomes 0).

    Means and spreads are fetched once, two numbers per column: every use of a row's z-scores has the same bits, so
    results can be joined back by them.
    """
    plain = df.withColumns({f"__v{i}": c for i, c in enumerate(filled_columns(df, columns))})
    names = [f"__v{i}" for i in range(len(columns))]
    stats = plain.agg(*[F.avg(n).alias(f"m{n}") for n in names], *[F.stddev_pop(n).alias(f"s{n}") for n in names]).first()
    parts = [(F.col(n) - stats[f"m{n}"]) / stats[f"s{n}"] if stats[f"s{n}"] else F.lit(0.0) for n in names]
    # Adding 0 turns -0.0 into 0.0, which group keys treat as equal anyway.
    return plain.withColumn(out, F.array(*[p + 0.0 for p in parts])).drop(*names)


def _curve(x: np.ndarray) -> list[bytes]:
    """Places on the Hilbert curve (Skilling's transform, 32 bits a component). Components are pressed into (-1, 1) first,
    so that a few far points do not leave a single cell to all others."""
    level = np.floor((x / (1 + np.abs(x)) + 1) * 2.0**31)
    c = list(np.minimum(level, 2.0**32 - 1).astype(np.uint32).T.copy())
    masks = [np.uint32((1 << bit) - 1) for bit in range(31, 0, -1)]
    for mask in masks:
        for i in range(len(c)):
            up = (c[i] & (mask + np.uint32(1))) != 0
            swap = np.where(up, np.uint32(0), (c[0] ^ c[i]) & mask)
            c[0] ^= np.where(up, mask, swap)
            c[i] ^= swap
    for i in range(1, len(c)):
        c[i] ^= c[i - 1]
    turn = np.zeros(len(x), np.uint32)
    for mask in masks:
        turn ^= np.where((c[-1] & (mask + np.uint32(1))) != 0, mask, np.uint32(0))
    cells = np.stack([part ^ turn for part in c], axis=1).astype(">u4")
    bits = np.unpackbits(cells.view(np.uint8).reshape(*x.shape, 4), axis=2)
    return [row.tobytes() for row in np.packbits(bits.transpose(0, 2, 1).reshape(len(x), -1), axis=1)]


@F.pandas_udf(BinaryType())
def _place(x: pd.Series) -> pd.Series:
    return pd.Series(_curve(np.stack(x.to_numpy())) if len(x) else [], dtype=object)


def on_curve(points: DataFrame) -> DataFrame:
    """The points, which are distinct in x array<double>, with `id`: their place along the curve, from 0. Stored."""
    placed = with_position(points.withColumn("__z", _place("x")), ["__z", "x"], out="id")
    return cut_lineage(placed.drop("__z"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy().reshape(len(rows), -1)


def _batches(n: int) -> Iterator[slice]:
    return (slice(i, i + BATCH) for i in range(0, n, BATCH))


def _bounds(df: DataFrame, low: str, high: str, size: int, key: str = "box", *more: Column) -> DataFrame:
    """The bounds of each box, component by component."""
    parts = [(F.min(F.col(low)[i]), F.max(F.col(high)[i])) for i in range(size)]
    return df.groupBy(key).agg(F.array(*[a for a, _ in parts]).alias("low"), F.array(*[b for _, b in parts]).alias("high"), *more)


def _boxes(known: DataFrame, n: int, size: int, k: int) -> tuple[DataFrame, list[DataFrame], tuple[np.ndarray, ...]]:
    """The known points with their box; the levels between, the finest first, as rows (box, child, low, high); and numbers
    and bounds of the at most FANOUT boxes on top."""
    # Points are dealt evenly, so every box holds more than k of them or is the only one.
    boxes = max(1, n // max(BOX_POINTS, k + 2))
    number = F.least(F.floor(F.col("id") * F.lit(boxes / n)), F.lit(boxes - 1)).cast("long")
    placed = known.withColumn("box", number)
    bounds, levels = _bounds(placed, "x", "x", size), []
    while boxes > FANOUT:
        boxes = -(-boxes // FANOUT)
        up = F.floor(F.col("box") / FANOUT).cast("long")
        levels.append(cut_lineage(bounds.select(up.alias("box"), F.col("box").alias("child"), "low", "high")))
        bounds = _bounds(levels[-1], "low", "high", size)
    top = bounds.orderBy("box").collect()
    return placed, levels, tuple(np.array([r[c] for r in top]) for c in ("box", "low", "high"))


def _near_boxes(
    x_low: np.ndarray, x_high: np.ndarray, radius: np.ndarray | None, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an asked cell and a box that comes within its radius; without radii the one box that is nearest, by its
    middle where several meet the cell."""
    cells, found = [], []
    for part in _batches(len(x_low)):
        a, b = x_low[part], x_high[part]
        gap = _gaps(a, b, low, high)
        if radius is None:
            off = np.zeros_like(gap)
            for i in range(a.shape[1]):
                off += ((low[:, i] + high[:, i]) / 2 - (a[:, i, None] + b[:, i, None]) / 2) ** 2
            box = np.where(gap == gap.min(axis=1, keepdims=True), off, np.inf).argmin(axis=1)
            cell = np.arange(len(a))
        else:
            cell, box = np.nonzero(gap <= radius[part, None] ** 2 * SLACK)
        cells.append(cell + part.start), found.append(box)
    return np.concatenate(cells), np.concatenate(found)


def _gaps(x_low: np.ndarray, x_high: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances between two sets of bounds."""
    gap = np.zeros((len(x_low), len(low)))
    for i in range(x_low.shape[1]):
        gap += np.maximum(np.maximum(low[:, i] - x_high[:, i, None], x_low[:, i, None] - high[:, i]), 0.0) ** 2
    return gap


def _meet(asked: DataFrame, held: DataFrame, tasks: int, most: int, key: str = "box"):
    """Asked rows and what their key holds together. The rows of a crowded key are spread over several groups, each with
    all that the key holds."""
    # One row for each `most` asked rows at the most.
    load = asked.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    load = F.broadcast(load)
    one = F.coalesce("parts", F.lit(1))
    asked = asked.join(load, key, "left").withColumn("part", F.pmod(F.xxhash64("id"), one).cast("int")).drop("parts")
    held = held.join(load, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    return _together(asked, held, tasks, key, "part")


def _together(asked: DataFrame, held: DataFrame, tasks: int, *keys: str):
    both = asked.withColumn("__asked", F.lit(True)).unionByName(held.withColumn("__asked", F.lit(False)), allowMissingColumns=True)
    # A fixed number of tasks: by size alone these groups look small, but each is much work.
    return both.repartition(tasks, *keys).groupBy(*keys)


def _sides(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    asked = rows.column("__asked").to_numpy()
    return rows.filter(pa.array(asked)), rows.filter(pa.array(~asked))


_AT = "id long, low array<double>, high array<double>, radius double, box long"


def _spread(asked: pa.Table | pa.RecordBatch, boxes: np.ndarray, low: np.ndarray, high: np.ndarray, own: bool) -> pa.Table:
    """A row for each asked cell and box that it goes to."""
    radius = None if own else asked.column("radius").to_numpy()
    cell, box = _near_boxes(_matrix(asked.column("low")), _matrix(asked.column("high")), radius, low, high)
    taken = [asked.column(c).take(pa.array(cell)) for c in ("id", "low", "high", "radius")]
    return pa.table([*taken, pa.array(boxes[box], pa.int64())], names=["id", "low", "high", "radius", "box"])


def _down(cells: DataFrame, levels: list[DataFrame], top: tuple[np.ndarray, ...], tasks: int, own: bool) -> DataFrame:
    """id and box: each asked cell (id, low, high, radius) with every box of points within its radius, or with the nearest one."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _spread(batch, *top, own).to_batches()

    def children(rows: pa.Table) -> pa.Table:
        a, b = _sides(rows)
        if not len(a) or not len(b):
            return a.select(["id", "low", "high", "radius", "box"]).slice(0, 0)
        return _spread(a, b.column("child").to_numpy(), _matrix(b.column("low")), _matrix(b.column("high")), own)

    at = cells.select("id", "low", "high", "radius").mapInArrow(first, _AT)
    for level in reversed(levels):
        at = _meet(cut_lineage(at), level, tasks, CELLS_PER_GROUP).applyInArrow(children, _AT)
    return at.select("id", "box")


def _kth(distance: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Distance at which the weights along each row reach k; infinite when they never do."""
    # Every weight but a point's own is at least 1, so the k + 1 nearest columns suffice.
    m = min(k + 1, distance.shape[1])
    first = np.argpartition(distance, m - 1, axis=1)[:, :m]
    d, w = np.take_along_axis(distance, first, 1), np.take_along_axis(weight, first, 1)
    order = np.argsort(d, axis=1, kind="stable")
    d = np.take_along_axis(d, order, 1)
    held = np.cumsum(np.take_along_axis(w, order, 1), axis=1)
    at = (held < k).sum(axis=1)
    safe = np.minimum(at, m - 1)
    return np.where(at < m, d[np.arange(len(d)), safe], np.inf)


def _distances(x: np.ndarray, y: np.ndarray, weight: np.ndarray, skip_self: bool) -> tuple[np.ndarray, np.ndarray]:
    d = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d += (x[:, i, None] - y[None, :, i]) ** 2
    w = np.broadcast_to(weight, d.shape)
    if skip_self:
        # A point is not its own neighbour, its other copies are.
        w = w - (d == 0)
    return np.sqrt(d), w


def _search(
    x: np.ndarray, radius: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, skip_self: bool
) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of x: rows of y, distances and weights of the k nearest within the radius, nearest first and ties by
    row; the distance is infinite where there are fewer. Both sides stand in the order of the curve."""
    leaf = max(LEAF_POINTS, k + 2)
    starts, asked = np.arange(0, len(y), leaf), np.arange(0, len(x), leaf)
    low, high = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
    for some in _batches(len(asked)):
        begins = asked[some]
        inner = x[begins[0] : begins[-1] + leaf]
        gaps = _gaps(np.minimum.reduceat(inner, begins - begins[0]), np.maximum.reduceat(inner, begins - begins[0]), low, high)
        for begin, gap in zip(begins.tolist(), gaps):
            part = slice(begin, min(begin + leaf, len(x)))
            nearest_leaf = int(gap.argmin())
            at = slice(max(nearest_leaf - 1, 0) * leaf, (nearest_leaf + 2) * leaf)
            reach = np.minimum(radius[part], _kth(*_distances(x[part], y[at], weight[at], skip_self), k))
            leaves = np.flatnonzero(gap <= reach.max() ** 2 * SLACK)
            rows = (leaves[:, None] * leaf + np.arange(leaf)).ravel()
            rows = rows[rows < len(y)]
            if not len(rows):
                continue
            m = min(k, len(rows))
            step = max(1, ENTRIES // len(rows))
            for i in range(part.start, part.stop, step):
                own = slice(i, min(i + step, part.stop))
                d, w = _distances(x[own], y[rows], weight[rows], skip_self)
                d = np.where((w > 0) & (d <= reach[own.start - begin : own.stop - begin, None] * SLACK), d, np.inf)
                # Every weight is at least 1, so k points always suffice.
                edge = np.partition(d, m - 1, axis=1)[:, m - 1, None]
                less, tied = d < edge, d == edge
                kept = less | (tied & (np.cumsum(tied, axis=1) <= m - less.sum(axis=1, keepdims=True)))
                j = np.nonzero(kept)[1].reshape(len(d), m)
                dj = np.take_along_axis(d, j, 1)
                order = np.argsort(dj, axis=1, kind="stable")
                j = np.take_along_axis(j, order, 1)
                yield own, rows[j], np.take_along_axis(dj, order, 1), np.take_along_axis(w, j, 1)


def _cells(asked: DataFrame, size: int, radius: Column) -> DataFrame:
    """Bounds and largest radius of asked points that follow each other along the curve."""
    own = asked.withColumn("cell", F.floor(F.col("id") / CELL_POINTS).cast("long"))
    return _bounds(own, "x", "x", size, "cell", F.max(radius).alias("radius")).withColumnRenamed("cell", "id")


LISTS = ("other", "d", "payload", "w")


def nearest_lists(asked: DataFrame, known: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """The k nearest known points (by weight) of each asked point, one row for each asked point: id and the arrays other,
    d, payload and w, nearest first. Stored. See `nearest`; with skip_self, asked and known are the same points."""
    schema = "id long, other array<long>, d array<double>, payload array<double>, w array<long>"
    spark = known.sparkSession
    n, size = known.agg(F.count("*"), F.max(F.size("x"))).first()
    asked_n = asked.count()
    if not n or not asked_n:
        return spark.createDataFrame([], schema)
    placed, levels, top = _boxes(known.select("id", "x", "w", "payload"), n, size, k)
    tasks = max(1, min(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), asked_n // ASKED_PER_GROUP), 2 * (n // BOX_POINTS + 1)))

    def bound(rows: pa.Table) -> pa.Table:
        a, b = _sides(rows)
        if not len(a) or not len(b):
            return a.select(["id", "x"]).slice(0, 0).append_column("radius", pa.array([], pa.float64()))
        a, b = a.sort_by([("box", "ascending"), ("id", "ascending")]), b.sort_by("box")
        x, y, weight = _matrix(a.column("x")), _matrix(b.column("x")), b.column("w").to_numpy()
        boxes, begin = np.unique(a.column("box").to_numpy(), return_index=True)
        held, radius = b.column("box").to_numpy(), []
        for box, first, last in zip(boxes, begin, [*begin[1:], len(x)]):
            at = slice(*np.searchsorted(held, [box, box + 1]))
            for part in _batches(last - first):
                radius.append(_kth(*_distances(x[first:last][part], y[at], weight[at], skip_self), k))
        return pa.table([a.column("id"), a.column("x"), pa.array(np.concatenate(radius))], names=["id", "x", "radius"])

    # An upper bound of each point's k-th distance, from one box near it.
    if skip_self:
        start = placed.select("id", "x", "box")
    else:
        own = _down(_cells(asked, size, F.lit(0.0)), levels, top, tasks, True).withColumnRenamed("id", "cell")
        cell = F.floor(F.col("id") / CELL_POINTS).cast("long")
        start = stored_columns(asked.select("id", "x", cell.alias("cell")).join(own, "cell").drop("cell"))
    unit = F.floor(F.col("box") / UNIT_BOXES).cast("long")
    met = _meet(start.withColumn("unit", unit), placed.drop("id", "payload").withColumn("unit", unit), tasks, ASKED_PER_GROUP, "unit")
    radius = stored_columns(met.applyInArrow(bound, "id long, x array<double>, radius double"))

    # Asked points in a row form a block; it needs every box that one of its cells comes near, a bounded number in each group.
    cells = max(1, min(ASKED_PER_GROUP, max(4 * CELL_POINTS, asked_n // tasks)) // CELL_POINTS)
    near = _down(_cells(radius, size, F.col("radius")), levels, top, tasks, False)
    near = near.select(F.floor(F.col("id") / cells).cast("long").alias("block"), "box").distinct()
    turn = F.floor((F.row_number().over(W.partitionBy("block").orderBy("box")) - 1) / BOXES_PER_GROUP).cast("int")
    near = cut_lineage(near.withColumn("turn", turn))
    turns = near.groupBy("block").agg((F.max("turn") + 1).alias("turns")).where("turns > 1")
    goes = radius.withColumn("block", F.floor(F.col("id") / (cells * CELL_POINTS)).cast("long")).join(F.broadcast(turns), "block", "left")
    goes = goes.withColumn("turns", F.coalesce("turns", F.lit(1))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))

    def visit(rows: pa.Table) -> pa.Table:
        a, b = _sides(rows)
        names = ["id", "turns", *LISTS]
        a, b = a.sort_by("id"), b.sort_by("id")  # ties at the k-th place go to the first one
        ids, turns = a.column("id").to_numpy(), a.column("turns").to_numpy()
        others, payload, weight = (b.column(c).to_numpy() for c in ("id", "payload", "w"))
        out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int64, np.float64, np.float64, np.int64)]
        sizes = [np.zeros(1, np.int32)]
        if len(a) and len(b):
            for part, j, d, w in _search(_matrix(a.column("x")), a.column("radius").to_numpy(), _matrix(b.column("x")), weight, k, skip_self):
                before = np.cumsum(w, axis=1) - w
                # Copies of the last neighbour beyond k do not count.
                kept = np.isfinite(d) & (before < k)
                sizes.append(kept.sum(axis=1).astype(np.int32))
                values = (others[j], d, payload[j], np.minimum(w, k - before))
                for to, more in zip(out, (ids[part], turns[part], *[v[kept] for v in values])):
                    to.append(more)
        ends = pa.array(np.cumsum(np.concatenate(sizes), dtype=np.int32))
        flat = [pa.array(np.concatenate(v)) for v in out]
        return pa.table([*flat[:2], *[pa.ListArray.from_arrays(ends, v) for v in flat[2:]]], names=names)

    held = placed.join(near, "box").drop("box")
    found = _together(goes, held, tasks, "block", "turn").applyInArrow(visit, schema.replace("id long", "id long, turns int"))
    found = stored_columns(found)
    if not turns.isEmpty():
        # Points whose boxes were dealt to several groups: the best of all.
        some = found.where("turns > 1").select("id", F.explode(F.arrays_zip(*LISTS)).alias("n")).select("id", *[F.col(f"n.{c}") for c in LISTS])
        order = W.partitionBy("id").orderBy("d", "other")
        best = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        before = F.coalesce(F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        best = best.withColumn("w", F.least("w", F.lit(k) - before)).where("w > 0")
        lists = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "other", "payload", "w"))).alias("n"))
        merged = lists.select("id", *[F.col(f"n.{c}").alias(c) for c in LISTS])
        return found.where("turns = 1").drop("turns").unionByName(stored_columns(merged))
    return found.drop("turns")


def nearest(asked: DataFrame, known: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """The k nearest known points (by weight) of each asked point.

    asked: id, x; known: id, x, w bigint, payload double; both numbered by `on_curve`, all x of one length. Result, a row
    per neighbour: id, `other` (the neighbour's id), distance d, payload, and w, the copies of it that count; these add up
    to k for a point. Ties go to the neighbour that comes first on the curve. No known points give no rows.
    """
    lists = nearest_lists(asked, known, k, skip_self)
    rows = lists.select("id", F.explode(F.arrays_zip(*LISTS)).alias("n"))
    return rows.select("id", "n.other", "n.d", "n.payload", "n.w")


def of_neighbours(lists: DataFrame, values: DataFrame, made: Callable[[np.ndarray, pa.Table], np.ndarray]) -> DataFrame:
    """id and a number that `made` finds for each list (see `nearest_lists`, asked among itself) from the values
    (id, value) of its neighbours: one for each entry of the lists, and the lists' rows, none of them empty.

    Neighbours are near each other along the curve, so only the values of a few neighbours move to another block.
    """
    block = F.floor(F.col("id") / ASKED_PER_GROUP).cast("long")
    own = values.withColumn("block", block)
    wanted = lists.select(block.alias("block"), F.explode("other").alias("id")).where(F.col("block") != block).distinct()
    held = own.unionByName(wanted.join(values, "id"))

    def run(rows: pa.Table) -> pa.Table:
        a, b = _sides(rows)
        b = b.sort_by("id")
        others = a.column("other").combine_chunks().flatten().to_numpy()
        found = b.column("value").to_numpy()[np.searchsorted(b.column("id").to_numpy(), others)]
        return pa.table([a.column("id"), pa.array(made(found, a) if len(a) else np.zeros(0))], names=["id", "value"])

    tasks = max(4 * int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), values.count() // ASKED_PER_GROUP)
    return _together(lists.withColumn("block", block), held, tasks, "block").applyInArrow(run, "id long, value double")
