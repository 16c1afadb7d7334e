"""Operator 2: nearest neighbours by vantage-point trees, one tree per shard.

The largest inner product is a nearest neighbour after one more component: with M the largest norm of a shard and
y = x / M, a vector becomes (y, sqrt(1 - |y|^2)) and a query r = q / |q| becomes (r, 0); their squared distance is 2 - 2 y.r.

A tree splits its points at the median distance from a vantage point, down to leaves. A block of queries goes
down together: the nearer side first, then the other side for the queries that its ring of distances can
still serve. By the triangle inequality a point in the ring [low, high] is at least max(d - high, low - d) away
from a query at distance d from the vantage point; the side is skipped where `factor` times the best distance
so far is below that. Factor one is exact; a smaller factor prunes more and may miss.

Shards hold about SHARD rows each, whatever the table's size, and rows whose largest components differ by less than
2^BAND, so a long vector does not blur the short ones beside it. Query blocks of about QUERY_BLOCK meet every shard,
and each meeting returns its k best; the k best of all shards are merged by query. Distances prune, with an allowance
for their rounding; what they leave is chosen by its score, computed on the original vectors in one order of
additions, so equal vectors have equal scores and ties go to the smaller id. Scores beyond the range of doubles are
infinite (or zero), and which of those come first is not defined.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id or vectors
of another length than a query's. Equal rows count once; rows that share an id and differ are queries and candidates
of their own, but no row is a candidate for a query of its id. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import stored
from flatwork.llm.vectors import matrices, usable

SHARD = 8192
QUERY_BLOCK = 1024
LEAF = 256
BAND = 4
FACTOR = 0.8
SEED = 5


def build(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> dict:
    """A tree over the given rows of x. Halves are cut by rank, so equal points split as well."""
    if len(rows) <= leaf:
        return {"rows": rows}
    vantage = x[rows[rng.integers(len(rows))]]
    d = np.sqrt(((x[rows] - vantage) ** 2).sum(axis=1))
    order = np.argsort(d, kind="stable")
    half = len(rows) // 2
    sides = []
    for part in (order[:half], order[half:]):
        sides.append((d[part[0]], d[part[-1]], build(x, rows[part], rng, leaf)))
    return {"vantage": vantage, "sides": sides}


class Search:
    """The best rows of one tree for a block of queries. x and queries are the raised vectors, whose distances prune;
    `score` gives the scores of pairs of a query and a row."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, score: Callable):
        self.x, self.ids, self.queries, self.query_ids, self.k, self.factor = x, ids, queries, query_ids, k, factor
        self.score = score
        self.best = np.full((len(queries), k), -np.inf)  # scores, falling
        self.found = np.full((len(queries), k), -1, np.int64)
        self.reach = np.full(len(queries), np.inf)  # the largest squared distance among the k best
        self.lengths = (x * x).sum(axis=1)
        self.query_lengths = (queries * queries).sum(axis=1)
        # Squared distances are at most 4; their rounding grows with the number of components.
        self.slack = 8e-16 * (x.shape[1] + 8)
        self.visited = 0

    def leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        self.visited += len(rows) * len(active)
        d = np.maximum(self.query_lengths[active, None] + self.lengths[rows] - 2 * (self.queries[active] @ self.x[rows].T), 0)
        d[self.query_ids[active, None] == self.ids[rows]] = np.inf
        near = np.isfinite(d) & (d <= self.reach[active, None] + self.slack)
        if d.shape[1] > self.k:  # the k nearest rows of the leaf, and what is as near up to rounding
            near &= d <= np.partition(d, self.k - 1, axis=1)[:, self.k - 1, None] + 2 * self.slack
        some = near.any(axis=1)
        active, d, near = active[some], d[some], near[some]
        if not len(active):
            return
        i, j = np.nonzero(near)
        scores = np.full(d.shape, -np.inf)
        scores[i, j] = self.score(active[i], rows[j])
        both = np.concatenate([self.best[active], scores], axis=1)
        which = np.concatenate([self.found[active], np.where(near, rows, -1)], axis=1)
        names = np.where(which >= 0, self.ids[which], np.iinfo(np.int64).max)
        order = np.lexsort((names, -both, which < 0), axis=1)[:, : self.k]
        self.best[active] = np.take_along_axis(both, order, axis=1)
        self.found[active] = found = np.take_along_axis(which, order, axis=1)
        full = (found >= 0).all(axis=1)
        last = self.x[found] - self.queries[active][:, None]
        self.reach[active] = np.where(full, (last * last).sum(axis=2).max(axis=1), np.inf)

    def down(self, node: dict, active: np.ndarray) -> None:
        if "rows" in node:
            return self.leaf(node["rows"], active)
        d = np.sqrt(np.maximum(((self.queries[active] - node["vantage"]) ** 2).sum(axis=1), 0))
        inner, outer = node["sides"]
        near = d <= (inner[1] + outer[0]) / 2
        for side, here in ((inner, near), (outer, ~near), (inner, ~near), (outer, near)):
            # Read again for each side: what the nearer one found prunes the other.
            far = np.maximum(d[here] - side[1], side[0] - d[here])
            go = here.nonzero()[0][far <= self.factor * np.sqrt(self.reach[active[here]] + self.slack) + 1e-9]
            if len(go):
                self.down(side[2], active[go])


def _raised(x: np.ndarray) -> np.ndarray:
    """Vectors scaled by the largest norm among them and raised to the unit sphere by one more component."""
    y = np.ldexp(x, -np.frexp(np.abs(x).max(initial=0))[1])  # a power of two, so no norm overflows
    y /= np.sqrt((y * y).sum(axis=1)).max(initial=1e-300) * (1 + 1e-12)
    return np.concatenate([y, np.sqrt(np.maximum(1 - (y * y).sum(axis=1), 0))[:, None]], axis=1)


def _turned(q: np.ndarray) -> np.ndarray:
    """Queries on the unit sphere, with a zero as their last component."""
    turned = np.ldexp(q, -np.frexp(np.abs(q).max(axis=1, keepdims=True))[1])
    turned /= np.sqrt((turned * turned).sum(axis=1, keepdims=True))
    return np.pad(turned, ((0, 0), (0, 1)))


def _scores(q: np.ndarray, x: np.ndarray):
    """Inner products of pairs of rows, with one order of additions for every pair."""

    def run(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        score = np.zeros(len(i))
        with np.errstate(over="ignore", invalid="ignore"):
            for c in range(q.shape[1]):
                score += q[i, c] * x[j, c]
        return score

    return run


def _grow(leaf: int):
    """One row per shard and length of vector: its ids, vectors and tree."""

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        out = []
        ids = table.column("vec_id").to_numpy()
        for rows, x in matrices(table.column("e").combine_chunks()):
            tree = build(_raised(x), np.arange(len(x)), np.random.default_rng(SEED), leaf)
            out.append({"shard": keys[0].as_py(), "size": x.shape[1], "tree": pickle.dumps((ids[rows], x, tree), protocol=5)})
        return pa.Table.from_pylist(out, pa.schema([("shard", pa.int64()), ("size", pa.int64()), ("tree", pa.binary())]))

    return run


def _search(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, loaded = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                shard, size = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if (shard, size) != last:  # rows come sorted by shard, so a tree is read once
                    ids, x, tree = pickle.loads(batch.column(2)[row].as_py())
                    last, loaded = (shard, size), (ids, x, _raised(x), tree)
                ids, x, raised, tree = loaded
                block = batch.column(3)[row].values
                query_ids, query_rows = block.field("vec_id").to_numpy(), block.field("row").to_numpy()
                for rows, q in matrices(block.field("e")):
                    if q.shape[1] != size:
                        continue
                    search = Search(raised, ids, _turned(q), query_ids[rows], k, factor, _scores(q, x))
                    search.down(tree, np.arange(len(q)))
                    i, j = np.nonzero(search.found >= 0)
                    arrays = [query_ids[rows][i], query_rows[rows][i], ids[search.found[i, j]], search.best[i, j]]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query_id", "row", "vec_id", "score"])

    return run


def nearest(
    df: DataFrame, queries: Column, k: int = 20, factor: float = FACTOR, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows with the largest inner product with each query row."""
    if not 0 < factor <= 1:
        raise ValueError("The factor lies above 0 and is at most 1.")
    rows = df.withColumn("__q", F.coalesce(queries, F.lit(False))).select(col(vec_id).cast("long").alias("vec_id"), col(embedding).alias("e"), "__q")
    rows = rows.where(usable(F.col("e")) & F.col("vec_id").isNotNull())
    # Rows of like length go together: a band is BAND binary digits of the largest component, so there are some 500 at most.
    size = F.array_max(F.transform("e", lambda v: F.abs(v.cast("double"))))
    rows = rows.withColumn("band", F.floor(F.log2(size) / BAND).cast("int"))
    bands = rows.groupBy("band").agg(F.count("*").alias("n"), F.count_if("__q").alias("q")).orderBy("band").collect()
    counts = [max(1, -(-b["n"] // shard)) for b in bands]
    starts = np.cumsum([0, *counts]).tolist()
    shards, blocks = starts[-1], max(1, -(-sum(b["q"] for b in bands) // QUERY_BLOCK))
    if not shards:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of_band = F.create_map(*[F.lit(v) for b, n, at in zip(bands, counts, starts) for v in (b["band"], f"{at} {n}")])
    place = F.split(F.element_at(of_band, F.col("band")), " ").cast("array<long>")
    # Dealt by a hash of the whole row: a repeated id is spread as well.
    trees = stored(
        rows.select("vec_id", "e", place.alias("place")).distinct()
        .withColumn("shard", F.col("place")[0] + F.pmod(F.xxhash64("vec_id", "e"), F.col("place")[1])).drop("place")
        .groupBy("shard")
        .applyInArrow(_grow(LEAF), "shard long, size long, tree binary")
    )
    asked = (
        rows.where("__q").select("vec_id", "e").distinct()
        .withColumn("row", F.xxhash64("vec_id", "e"))
        .groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "e", "row")).alias("queries"))  # about QUERY_BLOCK of them
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    )
    met = trees.join(asked, "shard").sortWithinPartitions("shard", "size").select("shard", "size", "tree", "queries")
    found = met.mapInArrow(_search(k, factor), "query_id long, row long, vec_id long, score double")
    order = W.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
