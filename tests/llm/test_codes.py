"""Vector codes against plain search over exact integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from flatwork.llm import codes


def plain(vectors, parts=8, entries=16, rounds=6):
    edges = codes.bounds(len(vectors[0]), parts)
    cuts = list(zip(edges, edges[1:]))
    whole = [[math.floor(Fraction(float(x)) * 4096) for x in v] for v in vectors]
    books = [[v[a:b] for v in whole[:entries]] for a, b in cuts]

    def assign():
        found = []
        for v in whole:
            apart = [[sum((x - c) ** 2 for x, c in zip(v[a:b], e)) for e in book] for (a, b), book in zip(cuts, books)]
            found.append([(d.index(min(d)), min(d)) for d in apart])
        return found

    for _ in range(rounds):
        found = assign()
        for p, (a, b) in enumerate(cuts):
            for k in range(len(books[p])):
                mine = [v[a:b] for v, f in zip(whole, found) if f[p][0] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    return books, assign()


def vectors(length, scale, wide=None):
    rng = np.random.default_rng(length)
    x = rng.normal(size=(90, length)) * scale
    x[2], x[40], x[7] = x[1], x[3], 0  # equal starting entries, copies, a zero vector
    if wide:
        x[wide] *= 1e12
    return x


@pytest.mark.parametrize("memory", [codes.MEMORY, 5])
@pytest.mark.parametrize("length, scale, wide", [(64, 0.1, None), (20, 0.01, None), (5, 2, None), (16, 1e-5, None), (16, 1, 50), (16, 1, 4)])
def test_blocks_equal_plain_search(monkeypatch, length, scale, wide, memory):
    import pyarrow as pa

    monkeypatch.setattr(codes, "MEMORY", memory)
    x = vectors(length, scale, wide)
    books, found = plain(x)
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64()))], ["e"])
    got = {}
    for _, rows, _, entries, apart in codes._blocks(iter([batch]), 0, books, 4096):
        for j, r in enumerate(rows):
            got[int(r)] = [(int(e[j]), int(d[j])) for e, d in zip(entries, apart)]
    assert [got[i] for i in range(len(x))] == found


def test_colliding_cells_are_evaluated_whole():
    near = codes.Nearest([[0, 0], [10, 10]], False)
    near.mix = np.zeros(2, np.int64)  # every cell has one hash
    v = np.array([[0, 1], [9, 9], [4, 4], [100, -3]])
    assert near(v)[0].tolist() == [0, 1, 0, 1] and near(v)[1].tolist() == [1, 2, 32, 8269]


def test_undominated_keeps_every_nearest_entry():
    rng = np.random.default_rng(3)
    book = rng.integers(-50, 50, (16, 3))
    low = rng.integers(-60, 60, (40, 3))
    kept = codes.undominated(low, 7, book)
    corner = np.array(np.meshgrid(*[range(7)] * 3)).reshape(3, -1).T
    for lo, mask in zip(low, kept):
        apart = (((lo + corner)[:, None] - book[None]) ** 2).sum(axis=2)
        assert mask[np.unique(np.nonzero(apart == apart.min(axis=1, keepdims=True))[1])].all()
    assert kept.mean() < 0.9


@pytest.mark.parametrize("length, wide", [(16, None), (16, 60), (10, None)])
def test_query_equals_plain_search(spark, length, wide):
    x = vectors(length, 1.0, wide)
    labels = [None if i % 3 == 0 else 1 if i % 3 == 1 else i for i in range(len(x))]
    rows = [(i * 3, [float(v) for v in r], labels[i], "x", 1) for i, r in enumerate(x)]
    bad = [None, [None] + [1.0] * (length - 1), [float("nan")] * length, [float("inf")] * length]
    rows += [(i, b, 1, "x", 1) for i, b in enumerate(bad)]  # among the smallest ids, but dropped
    rows += [(10**6, [1.0] * (length + 1), 1, "x", 1), (10**6 + 1, [], None, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, `a.b` int").repartition(4)
    books = codes.fit(df)
    want, found = plain(x)
    assert books == want
    got = {r["vec_id"]: r for r in codes.with_label_error(codes.encode(df, books)).collect()}
    assert set(got) == {r[0] for r in rows[: len(x)]} | {10**6, 10**6 + 1}
    errors = [sum(d for _, d in f) for f in found]
    for i, f in enumerate(found):
        r = got[i * 3]
        assert r["code"] == "".join(f"{e:02x}" for e, _ in f) and r["error"] == (errors[i] if errors[i] < 1 << 63 else None)
        total = sum(e for e, l in zip(errors, labels) if l == labels[i] and e < 1 << 63)
        assert r["label_error"] == total
    assert got[10**6]["code"] is None and got[10**6]["error"] is None
    assert codes.digest(books) == hashlib.sha256(",".join(str(c) for b in want for e in b for c in e).encode()).hexdigest()


def test_decoding_gives_the_entries(spark):
    x = vectors(16, 1.0)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    books = codes.fit(df)
    coded = codes.decode(codes.encode(df, books), books).join(df.select("vec_id", "embedding"), "vec_id")
    for r in coded.collect():
        apart = sum((math.floor(v * 4096) - int(d * 4096)) ** 2 for v, d in zip(r["embedding"], r["decoded"]))
        assert apart == r["error"]


def test_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(None, [1.0] * 8, 1), (4, [2.0] * 8, 1), (4, [1.5] * 8, None), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, schema)
    books = codes.fit(df)
    assert [len(b) for b in books] == [4] * 8 and books[0][:2] == [[6144], [8192]]
    got = codes.encode(df, books).orderBy("code").collect()
    assert [r["code"] for r in got] == ["00" * 8, "01" * 8, "02" * 8, "02" * 8] and all(r["error"] == 0 for r in got)
    for empty in (df.where("false"), spark.createDataFrame([(1, None, 1)], schema)):
        books = codes.fit(empty)
        assert books == [] and codes.with_label_error(codes.encode(empty, books)).count() == 0
        assert codes.decode(codes.encode(empty, books), books).count() == 0
    zero = spark.createDataFrame([(1, [], 1), (2, [], 1)], schema)
    assert [r["error"] for r in codes.encode(zero, codes.fit(zero)).collect()] == [0, 0]
    assert zero.select(F.size("embedding")).distinct().count() == 1
