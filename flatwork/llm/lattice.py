"""Operator 1: near-duplicate vectors by E8 lattice hashing.

Each of TABLES random projections takes a unit vector to eight dimensions, where it is decoded to the
nearest point of the E8 lattice: its home cell. It also probes the PROBES nearest neighbouring points. Two
vectors meet in a table where the home of one is a home or probe of the other. Cosines are verified in double
precision. At a cosine of 0.95 a table finds over half of all pairs, so 14 tables miss about one in 10**5.

Equal vectors are one row with a count. Cells without a second vector are dropped before vectors move. A
cell is compared as tiles of homes and of members, at most TILE each, so one crowded cell is many small
tasks. A tile pair returns counts of links and a spanning forest, never pairs. A link counts where its pair
meets first (lowest table, then the home of the smaller number): every task finds that out for itself, as
cells are computed by additions in a fixed order and so have the same bits everywhere.

Vectors that are null, zero or hold null or non-finite components link with nothing and are kept. Vectors of
different lengths never link. Repeated rows are vectors of their own, linked with each other; a null id takes
no part in the smallest id of a component. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import stored
from flatwork.llm.components import components, merge_labels
from flatwork.llm.vectors import matrices, usable

TABLES = 14
PROBES = 10
CELL_SIZE = 0.9
TILE = 1024
SEED = 11


@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest points with whole entries and an even sum."""
    r = np.rint(y)
    error = y - r
    odd = np.flatnonzero(np.mod(r.sum(axis=1), 2) == 1)
    worst = np.abs(error[odd]).argmax(axis=1)
    r[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return r


def nearest_point(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the better of two shifted copies of the even lattice."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


@functools.cache
def _projections(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(size, TABLES, 8)) / CELL_SIZE


def cells(unit: np.ndarray) -> np.ndarray:
    """For every vector and table, a number for the home cell and one for each probed cell."""
    n, size = unit.shape
    projections = _projections(size)
    y = np.zeros((n, TABLES, 8))
    for k in range(size):  # in a fixed order: the same bits in any batch
        y += unit[:, k, None, None] * projections[k]
    out = np.empty((n, TABLES, 1 + PROBES), np.int64)
    around = neighbours()
    for t in range(TABLES):
        home = nearest_point(y[:, t])
        off = y[:, t] - home
        gain = np.zeros((n, len(around)))
        for k in range(8):
            gain += off[:, k, None] * around[:, k]
        near = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        points = np.concatenate([home[:, None], home[:, None] + around[near]], axis=1)
        number = np.full(points.shape[:2], t * 1_000_003 + size, np.uint64)
        for k in range(8):
            number = (number ^ (2 * points[..., k]).astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            number ^= number >> np.uint64(29)
        out[:, t] = number.view(np.int64)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        for rows, x in matrices(batch.column(1)):
            for at in range(0, len(rows), 1024):
                found = cells(_unit(x[at : at + 1024])).reshape(-1)
                each = TABLES * (1 + PROBES)
                home = np.arange(len(found)) % (1 + PROBES) == 0
                arrays = [found, np.repeat(numbers[rows[at : at + 1024]], each), home]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["cell", "u", "home"])


def _first_meeting(p: np.ndarray, q: np.ndarray, cell: int, home_is_p: np.ndarray) -> np.ndarray:
    """Whether pairs (cells of the smaller number p, of the larger q) meet first in this cell, in this order."""
    by_p = (q == p[:, :, :1]).any(axis=2)  # the home of p is a cell of q, by table
    by_q = (p == q[:, :, :1]).any(axis=2)
    table = (by_p | by_q).argmax(axis=1)
    row = np.arange(len(p))
    from_p = by_p[row, table]
    home = np.where(from_p, p[row, table, 0], q[row, table, 0])
    return (home == cell) & (from_p == home_is_p)


def _compare(threshold: float):
    def solve(cell: int, homes: list, members: list) -> pa.RecordBatch | None:
        numbers = [np.array([r[0] for r in side]) for side in (homes, members)]
        x = [_unit(np.array([r[1] for r in side], np.float64)) for side in (homes, members)]
        copies = np.array([r[2] for r in members]), np.array([r[2] for r in homes])
        i, j = np.nonzero(x[0] @ x[1].T >= threshold)
        apart = numbers[0][i] != numbers[1][j]
        i, j = i[apart], j[apart]
        if not len(i):
            return None
        every, place = np.unique(np.concatenate([numbers[0][i], numbers[1][j]]), return_inverse=True)
        a, b = place[: len(i)], place[len(i) :]
        labels = merge_labels(np.arange(len(every)), a, b)
        codes = np.empty((len(every), TABLES, 1 + PROBES), np.int64)
        rows = np.empty((len(every), x[0].shape[1]))
        rows[a], rows[b] = x[0][i], x[1][j]
        codes[:] = cells(rows)
        links = np.zeros(len(every), np.int64)
        for s in range(0, len(i), 1 << 12):
            u, v = a[s : s + (1 << 12)], b[s : s + (1 << 12)]
            counts = _first_meeting(codes[np.minimum(u, v)], codes[np.maximum(u, v)], cell, u < v)
            np.add.at(links, u[counts], copies[0][j[s : s + (1 << 12)][counts]])
            np.add.at(links, v[counts], copies[1][i[s : s + (1 << 12)][counts]])
        arrays = [every, every[labels], links]
        return pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in arrays], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, members = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            vectors = batch.column(6)
            for row, (cell, i, j, home, u, n) in enumerate(zip(*columns)):
                if (cell, i, j) != key:
                    if homes and members and (made := solve(key[0], homes, members)) is not None:
                        yield made
                    key, homes, members = (cell, i, j), [], []
                (homes if home else members).append((u, vectors[row].values.to_numpy(zero_copy_only=False), n))
        if homes and members and (made := solve(key[0], homes, members)) is not None:
            yield made

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (smallest id reachable by links) and kept of every row."""
    if not 0.9 <= threshold <= 1:
        raise ValueError("The tables are laid out for a threshold between 0.9 and 1.")
    rows = df.select(col(vec_id).alias("vec_id"), col(embedding).alias("e")).withColumn("ok", usable(F.col("e")))
    fit = rows.where("ok")
    distinct = stored(
        fit.groupBy("e").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")).withColumn("u", F.monotonically_increasing_id())
    )
    met = stored(distinct.select("u", "e").mapInArrow(_cell_rows, "cell long, u long, home boolean"))
    sizes = met.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("members")).where("homes > 0 AND members > 1")
    sizes = sizes.select("cell", F.ceil(F.col("homes") / TILE).alias("ht"), F.ceil(F.col("members") / TILE).alias("mt"))
    tiled = met.join(sizes, "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("u"), F.col(n))
    homes = tiled.where("home").select("cell", own("ht").alias("i"), every("mt").alias("j"), F.lit(True).alias("home"), "u")
    members = tiled.select("cell", every("ht").alias("i"), own("mt").alias("j"), F.lit(False).alias("home"), "u")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = homes.unionByName(members).join(distinct.select("u", "n", "e"), "u").select("cell", "i", "j", "home", "u", "n", "e")
    dealt = dealt.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = stored(dealt.mapInArrow(_compare(threshold), "a long, b long, links long"))

    links = found.groupBy(F.col("a").alias("u")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b")).withColumnRenamed("node", "u")
    known = distinct.join(links, "u", "left").join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))
    firsts = known.groupBy("root").agg(F.min("first").alias("component"))
    known = known.join(firsts, "root").select("e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    linked = fit.select("vec_id", "e").join(known, "e").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
