"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flatwork.llm import lattice, vptree


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    near = x[rng.integers(0, 20, 200)] + rng.normal(size=(200, 16)) * 0.09
    x = np.concatenate([x, near, np.repeat(x[:1], 60, axis=0), x[1:2] * 7])  # a hot vector, and one of another length
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x.astype(np.float32).tolist())]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [float("inf")] * 16, [1.0, 2.0]]
    rows += [(1000 + i, b, 1) for i, b in enumerate(bad)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int"), x.astype(np.float32).astype(np.float64)


def test_lattice_points_are_the_nearest():
    y = np.random.default_rng(1).normal(size=(500, 8)) * 2
    p = lattice.nearest_point(y)
    around = lattice.neighbours()
    assert len(around) == 240 and ((around**2).sum(axis=1) == 2).all()
    assert ((2 * p) % 1 == 0).all() and (np.mod(p.sum(axis=1), 2) == 0).all()
    assert (((y[:, None] - p[:, None] - around) ** 2).sum(axis=2).min(axis=1) >= ((y - p) ** 2).sum(axis=1) - 1e-9).all()


def test_cells_do_not_depend_on_the_batch():
    x = np.random.default_rng(1).normal(size=(50, 16))
    whole = lattice.cells(x)
    for i in range(50):
        mine = lattice.cells(x[i : i + 1])[0]
        assert (mine[:, 0] == whole[i, :, 0]).all() and (np.sort(mine, axis=1) == np.sort(whole[i], axis=1)).all()


@pytest.mark.parametrize("tile", [lattice.TILE, 7])
def test_links_equal_brute_force(table, monkeypatch, tile):
    monkeypatch.setattr(lattice, "TILE", tile)
    df, x = table
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        lower = np.minimum(root, np.where(near, root[None, :], len(x)).min(axis=1))
        if (lower == root).all():
            break
        root = lower
    got = {r["vec_id"]: tuple(r)[1:] for r in lattice.near_duplicates(df).collect()}
    assert {i: got[i] for i in range(len(x))} == {i: (int(near[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(x))}
    assert all(got[1000 + i] == (0, 1000 + i, True) for i in range(7)) and near.sum() > 2000


def test_no_vectors(table):
    df, _ = table
    assert lattice.near_duplicates(df.where("false")).count() == 0
    assert vptree.nearest(df.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("shard", [vptree.SHARD, 100])
def test_factor_one_is_exact_with_ties(table, monkeypatch, shard):
    monkeypatch.setattr(vptree, "LEAF", 16)
    monkeypatch.setattr(vptree, "QUERY_BLOCK", 10)
    df, x = table
    again = df.unionByName(df.where("vec_id IN (0, 500)"))  # repeated rows count once
    got = {}
    for r in vptree.nearest(again, F.col("vec_id") % 20 == 0, k=20, factor=1.0, shard=shard).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    scores = (x[:, None, :] * x[None, :, :]).cumsum(axis=2)[..., -1]
    for q in range(0, len(x), 20):
        order = [i for i in np.lexsort((np.arange(len(x)), -scores[q])) if i != q][:20]
        assert [got[q][k][0] for k in range(1, 21)] == order
        np.testing.assert_allclose([got[q][k][1] for k in range(1, 21)], scores[q][order], rtol=1e-12)


def test_a_smaller_factor_looks_at_less():
    rng = np.random.default_rng(3)
    plain, asked = rng.normal(size=(4000, 8)), rng.normal(size=(50, 8))
    x, q = vptree._raised(plain), vptree._turned(asked)
    tree = vptree.build(x, np.arange(4000), np.random.default_rng(0), 64)
    seen, found = [], []
    for factor in (1.0, 0.5):
        search = vptree.Search(x, np.arange(4000), q, np.full(50, -1), 10, factor, vptree._scores(asked, plain))
        search.down(tree, np.arange(50))
        seen.append(search.visited), found.append(search.found)
    exact = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert (np.sort(found[0]) == np.sort(exact)).all() and seen[1] < seen[0]


def test_few_candidates(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (40, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 0.0), (20, 2, 2, -1.0)]


def _brute(x, queries, k):
    scores = (x[queries][:, None, :] * x[None, :, :]).cumsum(axis=2)[..., -1]
    return {q: [(i, s[i]) for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k] for q, s in zip(queries, scores)}


@pytest.mark.parametrize("norm", [1.0, 1e8, 1e12, 1e200, 1e-200])
def test_a_vector_of_another_scale_hides_no_neighbours(spark, norm):
    x = np.random.default_rng(4).normal(size=(400, 16))
    x[7] *= norm
    x[13] *= np.sqrt(norm)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == _brute(x, list(range(0, 400, 20)), 20)


def test_recall_at_the_registered_factor(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect())
    x = np.array([e for _, e in rows], dtype=np.float32).astype(np.float64)
    # Many copies with noise, so that the trees have something to leave out.
    rng = np.random.default_rng(6)
    x = np.concatenate([x + rng.normal(scale=0.05, size=x.shape) for _ in range(-(-3000 // len(x)))])
    made = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(made, F.col("vec_id") % 20 == 0, shard=1000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = _brute(x, list(range(0, len(x), 20)), 20)
    hits = sum(len(got[q] & {i for i, _ in near}) for q, near in want.items())
    assert hits >= 0.9 * 20 * len(want)


def test_rows_that_share_an_id_are_asked_apart(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0]), (None, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(20, 1, 1, 3.0), (20, 1, 2, 2.0), (20, 2, 1, 1.0), (20, 2, 2, 1.0)]
