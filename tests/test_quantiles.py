import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flatwork.operators import quantiles as quantiles_module
from flatwork.operators.aggregate import aggregate
from flatwork.operators.quantiles import modes, quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    hot = np.full(3000, 5.0)  # a third of all rows hold one value
    v = np.concatenate([hot, rng.normal(0, 100, 4000), rng.exponential(1e6, 2000)])
    out = pd.DataFrame({"g": np.where(np.arange(len(v)) % 3 == 0, "a", "b"), "v": v, "w": np.arange(len(v)) * 1.5})
    out.loc[::17, "v"] = None
    out.loc[::29, "g"] = None
    return out


@pytest.mark.parametrize("limit, sent", [(quantiles_module.OPEN_ROWS, 1 << 16), (20, 1 << 16), (20, 0), (0, 3)])
def test_quantiles_equal_numpy_with_a_hot_value(spark, frame, limit, sent, monkeypatch):
    monkeypatch.setattr(quantiles_module, "SENT_RANGES", sent)
    got = quantiles(spark.createDataFrame(frame), ["v", "w"], PROBS, limit=limit).first()
    for c in "vw":
        np.testing.assert_allclose(got[f"q_{c}"], frame[c].dropna().quantile(PROBS), rtol=1e-12)


def test_groups_keep_the_null_group(spark, frame):
    rows = quantiles(spark.createDataFrame(frame), ["v"], PROBS, ["g"], limit=30).collect()
    want = frame.groupby("g", dropna=False)["v"]
    assert {r["g"] for r in rows} == {"a", "b", None}
    for r in rows:
        part = want.get_group(r["g"]) if r["g"] else frame[frame["g"].isna()]["v"]
        np.testing.assert_allclose(r["q_v"], part.dropna().quantile(PROBS), rtol=1e-12)


def test_a_group_without_values_stays(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("b", None, 2), ("c", 3.0, 3)], "g string, v double, w int")
    got = aggregate(rows, ["g"], [("v", "median", "m"), ("w", "sum", "s")]).orderBy("g").collect()
    assert [tuple(r) for r in got] == [("a", 1.0, 1.0), ("b", None, 2.0), ("c", 3.0, 3.0)]


def test_mode_takes_the_smallest_of_ties(spark):
    rows = spark.createDataFrame([("x", 3), ("x", 2), ("x", 3), ("x", 2), ("y", None)], "g string, v int")
    assert [tuple(r) for r in modes(rows, "v", ["g"]).collect()] == [("x", 2, 2)]


def test_one_value_and_no_value(spark):
    rows = spark.createDataFrame([(7.0, None)] * 40, "v double, w double")
    got = quantiles(rows, ["v", "w"], [0.1, 0.9], limit=30).first()
    assert got["q_v"] == [7.0, 7.0] and got["q_w"] == [None, None]


@pytest.mark.parametrize("bits", quantiles_module.BITS)
def test_leading_bits_never_fall_where_numbers_rise(spark, bits):
    rng = np.random.default_rng(1)
    some = rng.integers(0, 0x7FEFFFFFFFFFFFFF, 20000).view(np.float64)
    powers = 2.0 ** np.arange(-1074, 1024)
    close = 1000 * (1 + rng.integers(0, 1 << 20, 5000) * 2.0**-45)
    sizes = np.concatenate([some, powers, np.nextafter(powers, 0), np.nextafter(powers, 2 * powers), close, rng.exponential(1e-310, 500), [0.0, 1.7e308, 5e-324]])
    sizes = np.unique(np.concatenate([sizes, -sizes, [np.inf, -np.inf]]))
    df = spark.createDataFrame(pd.DataFrame({"v": sizes})).select("v", quantiles_module.leading(F.col("v"), bits).alias("p"))
    got = df.toPandas().sort_values("v")["p"].to_numpy()
    assert (got[1:] >= got[:-1]).all() and len(np.unique(got)) < len(got)


def test_infinities_and_narrow_values(spark):
    rows = [(float("-inf"),), (1.0,), (float("nan"),), (float("inf"),), (None,)] + [(1000 + i * 1e-9,) for i in range(500)]
    got = quantiles(spark.createDataFrame(rows, "v double"), ["v"], [0.0, 0.5, 1.0], limit=10).first()["q_v"]
    assert got == [float("-inf"), float(np.quantile([r[0] for r in rows[5:]] + [1.0, 0.0, np.inf], 0.5)), float("inf")]
