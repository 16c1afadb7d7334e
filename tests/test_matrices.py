import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flatwork.operators import aggregate as A


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(11)
    n = 4000
    out = pd.DataFrame({"k.1": rng.integers(0, 40, n).astype(float), "grp": [f"g{v}" for v in rng.integers(0, 700, n)], "v": rng.integers(0, 50, n)})
    out.loc[: n // 3, "k.1"] = 7.0  # one x holds a third of all rows
    out.loc[::19, "grp"] = None
    out.loc[::23, "k.1"] = None
    return out


def spark_frame(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "`k.1` double, grp string, v long")


@pytest.mark.parametrize("block", [1, 64, 10_000])
def test_heatmap_fills_every_cell(spark, frame, block, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_VALUES", block)
    full = frame.dropna()
    want = full.pivot_table(index="k.1", columns="grp", values="v", aggfunc="sum", fill_value=0).stack().to_dict()
    got = A.heatmap(spark_frame(spark, frame), "k.1", "grp", "v", "sum").collect()
    assert len(got) == len(want) and {(r["k.1"], r["grp"]): r["value"] for r in got} == want
    assert A.heatmap(spark_frame(spark, frame), "k.1", "grp").columns == ["k.1", "grp", "value"]


def test_heatmap_gathers_only_blocks_of_group_values(spark, frame):
    plan = A.heatmap(spark_frame(spark, frame), "k.1", "grp", "v", "sum")._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_heatmap_counts_numbers_as_groups_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), ("b", None)], "x string, g int")
    rows = {(r["x"], r["g"]): r["value"] for r in A.heatmap(df, "x", "g").collect()}
    assert rows == {("a", "1"): 2, ("a", "2"): 0, ("b", "1"): 0, ("b", "2"): 1}
    assert A.heatmap(df.where("false"), "x", "g").count() == 0


def test_pivot_of_named_values_looks_nothing_up(spark, monkeypatch):
    monkeypatch.setattr(A, "_pivot_values", lambda *a: pytest.fail("looked up"))
    df = spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", "p", 3), ("c", "q", 4)], "x string, g string, v int")
    got = A.pivot_table(df, "x", "g", "v", "sum", values=["p", "r", "p"]).orderBy("x")
    assert got.columns == ["x", "p", "r"] and [tuple(r) for r in got.collect()] == [("a", 1, 0), ("b", 3, 0)]
    total = A.totals_matrix(df, "x", "g", "v", values=["p", "q"]).collect()
    assert [(r["x"], r["total"]) for r in total] == [("c", 4), ("a", 3), ("b", 3)]
