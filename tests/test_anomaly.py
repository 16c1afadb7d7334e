"""Neighbour methods against brute force on a small table with many copies of one point."""

import numpy as np
import pandas as pd
import pytest

from flatwork.operators.cleaning import anomaly, density, models, neighbours
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    p = np.vstack([rng.normal(0, 1, (250, 2)), rng.normal(6, 0.5, (120, 2)), rng.uniform(-4, 10, (60, 2)), np.repeat([[2.0, 2.0]], 150, 0)])
    z = (p - p.mean(0)) / p.std(0)
    return p, np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))


@pytest.fixture(scope="module")
def frame(spark, points):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(points[0])), "a": points[0][:, 0], "b": points[0][:, 1]})).persist()


@pytest.fixture
def small_boxes(monkeypatch):
    monkeypatch.setattr(neighbours, "BOX_POINTS", 80)
    monkeypatch.setattr(neighbours, "ASKED_PER_GROUP", 50)


def test_local_outlier_factor(frame, points, small_boxes):
    d = points[1].copy()
    np.fill_diagonal(d, np.inf)
    k = 10
    idx = np.argsort(d, 1, kind="stable")[:, :k]
    near = np.take_along_axis(d, idx, 1)
    density_ = 1 / (np.maximum(near[:, -1][idx], near).mean(1) + 1e-10)
    want = -(density_[idx] / density_[:, None]).mean(1)
    got = anomaly.local_outlier_factor(frame, ["a", "b"], k).toPandas().sort_values("id")
    np.testing.assert_allclose(got["anomaly_score"], want, rtol=1e-4)
    assert got["anomaly_flag"].sum() == pytest.approx(0.05 * len(got), abs=2)


def clusters(d, eps, need):
    near = d <= eps
    core = near.sum(1) >= need
    label, c = -np.ones(len(d), int), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i], todo = c, [i]
            while todo:
                for m in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[m] = c
                    todo.append(m)
            c += 1
    for i in np.flatnonzero(~core):
        reached = label[near[i] & core]
        label[i] = reached.min() if len(reached) else -1
    return label


@pytest.mark.parametrize("eps, need", [(0.5, 5), (0.12, 6)])
def test_dbscan(frame, points, eps, need):
    got = density.dbscan(frame, ["a", "b"], eps, need, ["id"]).toPandas().sort_values("id")
    want = clusters(points[1], eps, need)
    assert (got["cluster_label"].to_numpy() == want).all()
    assert (got["anomaly_flag"].to_numpy() == (want == -1)).all()


def test_nearest_imputation(frame, points, small_boxes):
    p, d = points
    value = p[:, 0] * 2 + p[:, 1]
    ask = np.arange(len(p)) % 7 == 0
    known = np.flatnonzero(~ask)
    rows = frame.withColumn("c", F.when(F.col("id") % 7 != 0, F.col("a") * 2 + F.col("b")))
    got = models.fill_nearest(rows, "c", ["a", "b"], 5).toPandas().sort_values("id")["c"].to_numpy()
    want = value[known[np.argsort(d[np.ix_(ask, known)], 1, kind="stable")[:, :5]]].mean(1)
    np.testing.assert_allclose(got[ask], want, rtol=1e-9)


def brute_nearest(x, w, k):
    """Distance and weight of each point's nearest other copies, as sorted lists of k distances."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    copies = np.repeat(np.arange(len(x)), w)
    out = []
    for i in range(len(x)):
        far = d[i, copies].tolist()
        far.remove(0.0)
        out.append(sorted(far)[:k])
    return out


@pytest.mark.parametrize("columns, parts", [(6, 40), (1, 3)])
def test_nested_boxes_in_many_columns_and_files(spark, monkeypatch, columns, parts):
    monkeypatch.setattr(neighbours, "BOX_POINTS", 10)
    monkeypatch.setattr(neighbours, "FANOUT", 4)  # five levels of boxes
    monkeypatch.setattr(neighbours, "ASKED_PER_GROUP", 30)
    rng = np.random.default_rng(7)
    x = np.unique(np.concatenate([rng.normal(size=(500, columns)), rng.normal(size=(100, columns)) * 1e-6 + 3, [[1e9] * columns]]).round(9), axis=0)
    w = rng.integers(1, 4, len(x))
    rows = [([float(v) for v in p], int(c), float(i)) for i, (p, c) in enumerate(zip(x, w))]
    known = neighbours.on_curve(spark.createDataFrame(rows, "x array<double>, w bigint, payload double").repartition(parts))
    k = 7
    got = neighbours.nearest(known, known, k, skip_self=True).toPandas()
    at = {r["id"]: int(r["payload"]) for r in known.collect()}
    assert sorted(at) == list(range(len(x)))
    lists = {i: [] for i in range(len(x))}
    for r in got.itertuples():
        assert at[r.other] == r.payload
        lists[at[r.id]] += [r.d] * r.w
    for i, far in enumerate(brute_nearest(x, w, k)):
        np.testing.assert_allclose(sorted(lists[i]), far, rtol=1e-9, atol=1e-15)


def test_equal_distances_go_to_the_first_on_the_curve(spark):
    known = neighbours.on_curve(spark.createDataFrame([([float(i)], 1, float(i)) for i in range(9)], "x array<double>, w bigint, payload double"))
    got = neighbours.nearest(neighbours.on_curve(spark.createDataFrame([([4.0],)], "x array<double>")), known, 2)
    assert [r["payload"] for r in got.orderBy("d", "other").collect()] == [4.0, 3.0]
    assert neighbours.nearest(known, known.where("false"), 2).count() == 0


def test_neighbours_on_the_curve_are_neighbours_in_space():
    grid = np.array([[i, j] for i in range(16) for j in range(16)]) / 8.0 - 1 + 1 / 16
    x = grid / (1 - np.abs(grid))  # pressed back into the even grid
    path = grid[np.argsort(np.array(neighbours._curve(x), dtype=object), kind="stable")]
    np.testing.assert_allclose(np.abs(np.diff(path, axis=0)).sum(axis=1), 1 / 8)


def test_local_outlier_factor_of_an_empty_table(frame):
    assert anomaly.local_outlier_factor(frame.where("false"), ["a", "b"]).count() == 0


def test_chained_imputation_recovers_a_linear_column(frame, points):
    rows = frame.withColumn("c", F.when(F.col("id") % 7 != 0, F.col("a") * 2 + F.col("b")))
    got = models.fill_chained(rows, ["c", "a", "b"], 2).toPandas().sort_values("id")["c"].to_numpy()
    np.testing.assert_allclose(got, points[0][:, 0] * 2 + points[0][:, 1], atol=1e-8)


def test_isolation_forest_flags_the_far_points(frame):
    far = frame.sparkSession.createDataFrame([(9000 + i, 60.0 + i, -70.0 - i) for i in range(5)], "id int, a double, b double")
    got = anomaly.isolation_forest(frame.withColumn("id", F.col("id").cast("int")).unionByName(far), ["a", "b"], 0.02).toPandas()
    assert set(got.nsmallest(5, "anomaly_score")["id"]) == {9000, 9001, 9002, 9003, 9004}
    assert got["anomaly_flag"].sum() == pytest.approx(0.02 * len(got), abs=2)


def test_isolation_forest_does_not_depend_on_splits_or_order(frame):
    scores = []
    for df in (frame.repartition(2), frame.repartition(9, "id"), frame.orderBy(F.desc("b")).coalesce(1)):
        got = anomaly.isolation_forest(df, ["a", "b"], 0.05).orderBy("id").select("id", "anomaly_score", "anomaly_flag")
        scores.append([tuple(r) for r in got.collect()])
    assert scores[0] == scores[1] == scores[2]


def test_pool_of_the_forest_holds_groups_of_copies_by_their_share(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1.0).otherwise(F.col("id") * 1.0).alias("v"))
    pool = anomaly._pool(rows, ["v"], 60_000, 3000).toPandas()
    assert len(pool) == pytest.approx(3000, rel=0.1) and (pool["v"] == -1).sum() == pytest.approx(1000, abs=1)
    assert len(pool.drop_duplicates()) == len(pool)
    drawn = anomaly._draws(spark.createDataFrame(pool), ["v"], 3000, 20, 64).groupBy("tree").agg(
        F.count("*").alias("n"), F.avg((F.col("v") == -1).cast("int")).alias("hot")
    ).toPandas()
    assert len(drawn) == 20 and (drawn["n"] == 64).all() and drawn["hot"].mean() == pytest.approx(1 / 3, abs=0.06)
    whole = anomaly._pool(rows.limit(50), ["v"], 50, 3000)
    assert whole.count() == 50


def test_isolation_forest_of_few_and_equal_rows(spark):
    same = spark.createDataFrame([(i, 4.0, None) for i in range(30)], "id int, a double, b double")
    got = anomaly.isolation_forest(same, ["a"], 0.1).toPandas()
    assert len(got) == 30 and got["anomaly_flag"].sum() == 0


def test_cooks_distance(frame, points):
    x, y = np.c_[np.ones(len(points[0])), points[0][:, 0]], points[0][:, 1]
    hat = x @ np.linalg.inv(x.T @ x) @ x.T
    e, h = y - hat @ y, np.diag(hat)
    want = e**2 * h / (2 * (e @ e / (len(y) - 2)) * (1 - h) ** 2)
    got = anomaly.cooks_distance(frame, ["a"], "b").toPandas().sort_values("id")["anomaly_score"]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_methods_check_their_input(frame):
    with pytest.raises(ValueError):
        anomaly.flag_anomalies(frame, ["a"], "dbscan")
    with pytest.raises(ValueError):
        anomaly.flag_anomalies(frame, ["a", "b"], "unknown")
    with pytest.raises(ValueError):
        anomaly.flag_anomalies(frame, ["a"] * 2, "cooks_distance", {"target_column": "nope"})


def test_few_asked_points_and_boxes_over_several_groups(spark, monkeypatch):
    for name, value in (("BOX_POINTS", 10), ("FANOUT", 4), ("CELL_POINTS", 8), ("UNIT_BOXES", 2), ("BOXES_PER_GROUP", 3), ("LEAF_POINTS", 8), ("ENTRIES", 50)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    x = np.unique(rng.normal(size=(400, 2)).round(6), axis=0)
    w = rng.integers(1, 4, len(x))
    rows = [([float(v) for v in p], int(c), float(i)) for i, (p, c) in enumerate(zip(x, w))]
    known = neighbours.on_curve(spark.createDataFrame(rows, "x array<double>, w bigint, payload double"))
    ask = np.concatenate([rng.normal(2, 0.1, size=(30, 2)), [[9.0, -9.0]]])  # most boxes are asked by no point
    asked = neighbours.on_curve(spark.createDataFrame([([float(v) for v in p],) for p in ask], "x array<double>"))
    got = neighbours.nearest_lists(asked, known, 7).join(asked, "id").collect()
    assert len(got) == len(ask)
    for r in got:
        far = np.sort(np.repeat(np.sqrt(((x - np.array(r["x"])) ** 2).sum(1)), w))[:7]
        np.testing.assert_allclose(np.repeat(r["d"], r["w"]), far, rtol=1e-12)
        np.testing.assert_allclose(np.sqrt(((x[np.array(r["payload"], int)] - np.array(r["x"])) ** 2).sum(1)), r["d"], rtol=1e-12)


def test_local_outlier_factor_moves_points_and_not_their_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame(pd.DataFrame({"id": range(3000), "a": rng.normal(size=3000), "b": rng.normal(size=3000)}))
    moved = []

    def counted(asked, held, *more):
        moved.append(asked.count() + held.count())
        return together(asked, held, *more)

    together = neighbours._together
    monkeypatch.setattr(neighbours, "_together", counted)
    monkeypatch.setattr(neighbours, "ASKED_PER_GROUP", 1000)
    assert anomaly.local_outlier_factor(frame, ["a", "b"], 20).where("anomaly_score is null").count() == 0
    assert sum(moved[-2:]) < 5 * 3000  # a row for each of 20 neighbours moved before, twice
