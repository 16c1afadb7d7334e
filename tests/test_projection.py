import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flatwork.operators import projection as P


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 3000
    rows = pd.DataFrame(
        {
            "id": rng.permutation(n),
            "same": "x",
            "late": ["a" if i < 2500 else f"v{i}" for i in range(n)],
            "few": [f"f{i % 3}" for i in range(n)],
            "many": [f"m{i}" for i in range(n)],
        }
    )
    rows["late"] = rows["id"].map(lambda i: "a" if i < 2500 else f"v{i}")
    rows["gap"] = rows["id"].map(lambda i: f"g{i // 7}" if i > 2000 and i % 2 else None)
    rows["none"] = None
    schema = "id long, same string, late string, few string, many string, gap string, none string"
    return rows, spark.createDataFrame(rows.astype(object).where(rows.notna(), None), schema).repartition(7)


COLUMNS = ["same", "late", "few", "many", "gap", "none"]


def listed(df):
    out: dict[str, list] = {}
    for r in df.orderBy("column_name", "rank").collect():
        out.setdefault(r["column_name"], []).append(r["value"])
        assert r["rank"] == len(out[r["column_name"]])
    return out


@pytest.mark.parametrize("n", [1, 5, 120])
def test_first_distinct_values_equal_a_plain_loop(frame, n):
    rows, df = frame
    ordered = rows.sort_values("id")
    want = {c: ordered[c].dropna().drop_duplicates().tolist()[:n] for c in COLUMNS}
    assert listed(P.first_distinct_values(df, COLUMNS, ["id"], n)) == {c: v for c, v in want.items() if v}


@pytest.mark.parametrize("from_end", [False, True])
def test_edge_values_equal_a_plain_loop(frame, from_end):
    rows, df = frame
    ordered = rows.sort_values("id", ascending=not from_end)
    want = {c: ordered[c].dropna().tolist()[:6] for c in COLUMNS}
    assert listed(P.edge_values(df, COLUMNS, ["id"], 6, from_end)) == {c: v for c, v in want.items() if v}


def test_rows_that_tie_are_ordered_by_value(spark):
    rows = [(1, f"t{i % 400:03}") for i in range(2000)] + [(None, "first"), (0, "second")]
    df = spark.createDataFrame(rows, "at int, v string").repartition(5)
    assert listed(P.first_distinct_values(df, ["v"], ["at"], 4)) == {"v": ["first", "second", "t000", "t001"]}
    assert listed(P.edge_values(df, ["v"], ["at"], 3, True)) == {"v": ["t000", "t000", "t000"]}


def test_empty_table_and_column_names(spark):
    df = spark.createDataFrame([(1, "p", "q")], "`a.b` int, value string, at string")
    assert listed(P.first_distinct_values(df, ["a.b", "value", "at"], ["a.b"], 2)) == {"a.b": ["1"], "value": ["p"], "at": ["q"]}
    assert listed(P.first_distinct_values(df.limit(0), ["value"], ["a.b"], 2)) == {}
    assert P.sample_rows(df.limit(0), 50_000, ["a.b"]).count() == 0


@pytest.mark.parametrize("n", [41, 700, 2999, 3000, 9000])
@pytest.mark.parametrize("ranked, letters", [(40, 1), (0, 2), (1, 4)])
def test_large_samples_take_the_first_rows_without_sorting_the_table(frame, n, ranked, letters, monkeypatch):
    rows, df = frame
    monkeypatch.setattr(P, "RANKED_ROWS", ranked)
    monkeypatch.setattr(P, "COUNTED_LETTERS", letters)
    ids = sorted(rows["id"], key=lambda i: hashlib.md5(f"42{i}".encode()).hexdigest())
    got = P.sample_rows(df, n, ["id"])
    assert sorted(r["id"] for r in got.select("id").collect()) == sorted(ids[:n])


def test_a_sample_of_five_million_rows_has_no_ranked_task_of_that_size(spark):
    df = spark.range(6_000_000)
    got = P.sample_rows(df, 5_000_000, ["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    limits = [int(part.split(",")[0]) for part in plan.split("TakeOrderedAndProject(limit=")[1:]]
    assert all(x <= P.RANKED_ROWS for x in limits) and got.count() == 5_000_000


def test_equal_keys_stay_within_the_sample(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED_ROWS", 10)
    df = spark.range(900).select((F.col("id") % 3).alias("k"))
    assert P.sample_rows(df, 100, ["k"]).count() == 100
