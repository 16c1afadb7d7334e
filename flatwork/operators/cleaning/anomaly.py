"""Rows that are unusual in several columns together. Each method adds a score or label and a flag."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flatwork.functions.coerce import num
from flatwork.operators.cleaning.density import dbscan
from flatwork.operators.cleaning.neighbours import filled_columns, nearest_lists, of_neighbours, on_curve, with_standardised
from flatwork.operators.quantiles import quantiles
from flatwork.sources.checkpoints import stored_columns

TREES = 100
TREE_ROWS = 256
HASHES = 1 << 40
#: Rows of the pool that trees draw from, for each row that one of them takes.
POOL_SAMPLES = 2


def _quadratic(parts: Sequence[Column], matrix: np.ndarray) -> Column:
    """parts' M parts as one expression; M is symmetric."""
    out = F.lit(0.0)
    for i in range(len(parts)):
        for j in range(i, len(parts)):
            weight = float(matrix[i, j]) * (1 if i == j else 2)
            out = out + F.lit(weight) * parts[i] * parts[j]
    return out


def _comoments(work: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population covariance of columns, from one aggregate."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = work.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(len(names))]), cov


def mahalanobis(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Distance from the mean in units of the sample covariance (pseudo-inverse)."""
    names = [f"__v{i}" for i in range(len(columns))]
    work = df.withColumns(dict(zip(names, filled_columns(df, columns))))
    n, means, cov = _comoments(work, names)
    inverse = np.linalg.pinv(cov * n / (n - 1)) if n > 1 else np.zeros_like(cov)
    parts = [F.col(c) - F.lit(float(m)) for c, m in zip(names, means)]
    score = F.sqrt(F.greatest(_quadratic(parts, inverse), F.lit(0.0)))
    scored = work.withColumn("anomaly_score", score).drop(*names)
    return scored.withColumn("anomaly_flag", (F.col("anomaly_score") > float(threshold)).cast("int"))


def cooks_distance(df: DataFrame, columns: Sequence[str], target: str, threshold: float | None = None) -> DataFrame:
    """Influence of each complete row on the least-squares fit of `target`; other rows: no score, flag 0."""
    names = [f"__v{i}" for i in range(len(columns))]
    work = df.withColumns({**{v: num(df, c) for v, c in zip(names, columns)}, "__y": num(df, target)})
    complete = F.col("__y").isNotNull()
    for v in names:
        complete = complete & F.col(v).isNotNull()
    n, means, cov = _comoments(work.where(complete), [*names, "__y"])
    d = len(columns)
    p = d + 1
    if n <= p:
        raise ValueError("Not enough complete rows for Cook's distance.")
    spread = np.linalg.pinv(cov[:d, :d] * n)
    beta = spread @ (cov[:d, d] * n)
    error = max(cov[d, d] * n - beta @ (cov[:d, d] * n), 0.0) / (n - p)
    parts = [F.col(v) - F.lit(float(m)) for v, m in zip(names, means)]
    residual = F.col("__y") - F.lit(float(means[d]))
    for b, part in zip(beta, parts):
        residual = residual - F.lit(float(b)) * part
    leverage = F.lit(1.0 / n) + _quadratic(parts, spread)
    influence = F.try_divide(residual * residual * leverage, F.lit(p * error) * (1 - leverage) * (1 - leverage))
    limit = 4.0 / n if threshold is None else float(threshold)
    scored = work.withColumn("anomaly_score", F.when(complete, influence)).drop(*names, "__y")
    flag = F.coalesce(F.col("anomaly_score") > limit, F.lit(False)).cast("int")
    return scored.withColumn("anomaly_flag", flag)


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def _random_tree(x: np.ndarray, seed: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, path) of one isolation tree."""
    rng, depth_limit = np.random.default_rng(seed), math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) < 2 or not len(usable):
            return at
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = rows[:, f] <= cut
        left, right = grow(rows[goes_left], depth + 1), grow(rows[~goes_left], depth + 1)
        nodes[at] = (f, cut, left, right, 0.0)
        return at

    grow(x, 0)
    return nodes


def _tree_arrays(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut, children and path length per node; a leaf leads to itself, so no step needs a test."""
    feature, own = nodes["feature"].to_numpy(), np.arange(len(nodes))
    leaf = feature < 0
    child = np.empty(2 * len(nodes), dtype=np.int64)
    child[0::2] = np.where(leaf, own, nodes["left_node"].to_numpy())
    child[1::2] = np.where(leaf, own, nodes["right_node"].to_numpy())
    return np.where(leaf, 0, feature), nodes["cut"].to_numpy(), child, nodes["path"].to_numpy()


def _pool(work: DataFrame, names: Sequence[str], n: int, size: int) -> DataFrame:
    """About `size` of the n rows: their values and `copy`, which numbers rows of equal values.

    Rows of equal values are counted before they move. Each group gives its share of copies, rounded up or down by a
    hash of its values: one row in a thousand goes in with a chance of its share, a group of a third of all rows with
    a third of the pool.
    """
    share = min(1.0, size / max(n, 1))
    chance = F.pmod(F.xxhash64(*names, F.lit(42)), F.lit(HASHES)) / float(HASHES)
    groups = work.groupBy(*names).agg(F.count("*").alias("__n"))
    counted = groups.select(*names, F.floor(F.col("__n") * share + chance).cast("long").alias("__n")).where("__n > 0")
    return counted.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("copy"))


def _draws(pool: DataFrame, names: Sequence[str], size: int, trees: int, rows: int) -> DataFrame:
    """The rows of each tree: those of a pool of about `size` rows with the lowest hashes for that tree.

    About twice as many as a tree needs pass a first bound on the hash, so few are ranked.
    """
    share = int(min(1.0, (2 * rows + 64) / max(size, 1)) * HASHES)
    place = lambda t: F.pmod(F.xxhash64(*names, "copy", t, F.lit(42)), F.lit(HASHES))
    first = W.partitionBy("tree").orderBy("__r", *names, "copy")
    drawn = pool.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < share)))
    ranked = drawn.withColumn("__r", place(F.col("tree"))).withColumn("__at", F.row_number().over(first))
    return ranked.where(F.col("__at") <= rows).drop("__at", "copy")


def isolation_forest(df: DataFrame, columns: Sequence[str], contamination: float = 0.05, trees: int = TREES) -> DataFrame:
    """Isolation forest: 100 trees of 256 rows each, grown in parallel, scored in Arrow batches.

    The forest has at most trees * 511 nodes whatever the table size, so every task can hold it. It depends on the
    values of the columns alone, not on files, splits or the order of rows.
    """
    names = [f"__v{i}" for i in range(len(columns))]
    work = df.withColumns(dict(zip(names, filled_columns(df, columns))))
    n = work.count()
    rows_per_tree = min(TREE_ROWS, n)

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__r", *names]).head(rows_per_tree)
        nodes = _random_tree(rows[names].to_numpy(dtype=float), int(key[0]))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left_node", "right_node", "path"])
        return out.assign(tree=key[0], node=range(len(nodes)))

    size = POOL_SAMPLES * trees * rows_per_tree
    draws = _draws(_pool(work, names, n, size), names, min(n, size), trees, rows_per_tree)
    schema = "feature int, cut double, left_node int, right_node int, path double, tree int, node int"
    grown = draws.groupBy("tree").applyInPandas(grow, schema).toPandas().sort_values(["tree", "node"])
    forest = [_tree_arrays(g) for _, g in grown.groupby("tree")]
    depth_limit = math.ceil(math.log2(max(rows_per_tree, 2)))
    scale = max(float(average_path(rows_per_tree)), 1e-12)

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        cells, first, depth = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
        for feature, cut, child, path in forest:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth_limit):
                node = child[2 * node + (cells[first + feature[node]] > cut[node])]
            depth += path[node]
        return pd.Series(-(2.0 ** (-depth / len(forest) / scale)))

    scored = work.withColumn("__s", score(*[F.col(c) for c in names])).drop(*names)
    limit = quantiles(scored.select("__s"), ["__s"], [float(contamination)]).first()["q___s"][0]
    out = scored.withColumn("anomaly_score", F.col("__s") - F.lit(float(limit))).drop("__s")
    return out.withColumn("anomaly_flag", (F.col("anomaly_score") < 0).cast("int"))


def local_outlier_factor(df: DataFrame, columns: Sequence[str], neighbours: int = 20, contamination: float = 0.05) -> DataFrame:
    """How much thinner the surroundings of a row are than those of its nearest rows, on z-scores.

    The score is the negated factor; the lowest share `contamination` is flagged.
    """
    work = with_standardised(df, columns)
    points = on_curve(work.groupBy(F.col("__x").alias("x")).agg(F.count("*").alias("w"), F.lit(0.0).alias("payload")))
    total = points.agg(F.sum("w")).first()[0] or 0
    k = max(1, min(int(neighbours), total - 1))
    near = nearest_lists(points, points, k, skip_self=True).where(F.size("other") > 0)
    far = near.select("id", F.element_at("d", -1).alias("value"))

    def flat(rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).combine_chunks().flatten().to_numpy()

    def mean(values: np.ndarray, rows: pa.Table) -> np.ndarray:
        w, sizes = flat(rows, "w"), pc.list_value_length(rows.column("other")).to_numpy()
        begins = np.cumsum(sizes) - sizes
        return np.add.reduceat(w * values, begins) / np.add.reduceat(w, begins)

    def dense(values: np.ndarray, rows: pa.Table) -> np.ndarray:
        return 1.0 / (mean(np.maximum(flat(rows, "d"), values), rows) + 1e-10)

    density = stored_columns(of_neighbours(near.select("id", "other", "d", "w"), far, dense))
    around = of_neighbours(near.select("id", "other", "w"), density, mean)
    factors = around.withColumnRenamed("value", "around").join(density, "id").join(points, "id").select(
        F.col("x").alias("__fx"), (-F.col("around") / F.col("value")).alias("anomaly_score")
    )
    factors = stored_columns(factors)
    scored = work.join(factors, F.col("__x") == F.col("__fx"), "left").drop("__x", "__fx")
    limit = quantiles(scored.select("anomaly_score"), ["anomaly_score"], [float(contamination)]).first()["q_anomaly_score"]
    return scored.withColumn("anomaly_flag", (F.col("anomaly_score") < F.lit(limit[0] if limit else None).cast("double")).cast("int"))


def flag_anomalies(df: DataFrame, columns: Sequence[str], method: str, params: dict | None = None) -> DataFrame:
    """Apply one method over several columns. No row is removed."""
    params = params or {}
    if not columns or len(columns) < 2:
        raise ValueError("At least two numeric columns are needed.")
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"Column '{c}' does not exist.")
    match method:
        case "ignore":
            return df
        case "isolation_forest":
            return isolation_forest(df, columns, params.get("contamination", 0.05))
        case "mahalanobis_distance":
            return mahalanobis(df, columns, params.get("threshold", 3.0))
        case "local_outlier_factor":
            return local_outlier_factor(df, columns, params.get("n_neighbors", 20), params.get("contamination", 0.05))
        case "dbscan":
            return dbscan(df, columns, params.get("eps", 0.5), params.get("min_samples", 5), params.get("key"))
        case "cooks_distance":
            if not params.get("target_column") or params["target_column"] not in df.columns:
                raise ValueError("Cook's distance needs a target column of the table.")
            return cooks_distance(df, columns, params["target_column"], params.get("threshold"))
    raise ValueError(f"Unsupported anomaly method: {method}")
