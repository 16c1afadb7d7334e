import numpy as np
import pandas as pd
import pytest

from flatwork.operators import ordered as O


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    out = pd.DataFrame({"t": rng.permutation(n), "v": rng.normal(size=n)})
    out["u"] = np.where(out["t"] % 3 == 0, 0, rng.integers(1, 40, n))  # one user holds a third of the rows
    out.loc[rng.random(n) < 0.6, "v"] = None
    out.loc[(out["t"] > 800) & (out["t"] < 1600), "v"] = None  # a gap longer than several ranges
    return out


def run(spark, frame, fn, part, **kw):
    got = fn(spark.createDataFrame(frame), "v", ["t"], partition_by=part, **kw).toPandas()
    return got.sort_values("t")["v"].to_numpy()


@pytest.mark.parametrize("part", [[], ["u"]])
@pytest.mark.parametrize("ranges", [None, 1, 25])
def test_fills_equal_pandas(spark, frame, part, ranges):
    s = frame.sort_values("t")
    each = s.groupby("u")["v"] if part else s["v"]
    np.testing.assert_allclose(run(spark, frame, O.forward_fill, part, ranges=ranges), each.ffill())
    np.testing.assert_allclose(run(spark, frame, O.backward_fill, part, ranges=ranges), each.bfill())


@pytest.mark.parametrize("part", [[], ["u"]])
def test_interpolation_equals_pandas(spark, frame, part):
    s = frame.sort_values("t")
    want = s.groupby("u")["v"].transform(lambda x: x.interpolate()) if part else s["v"].interpolate()
    np.testing.assert_allclose(run(spark, frame, O.interpolate_linear, part, ranges=15), want)


@pytest.mark.parametrize("part", [[], ["u"]])
def test_rolling_mean_equals_pandas(spark, frame, part):
    s = frame.sort_values("t")
    roll = lambda x: x.rolling(5, min_periods=1).mean()
    want = s.groupby("u")["v"].transform(roll) if part else roll(s["v"])
    got = O.rolling_mean(spark.createDataFrame(frame), "v", ["t"], 5, part, "v", 30, 100).toPandas().sort_values("t")["v"]
    np.testing.assert_allclose(got, want)


def test_positions_are_dense_per_partition(spark, frame):
    got = O.with_position(spark.createDataFrame(frame), ["t"], ["u"], "at", 20).toPandas()
    want = frame.sort_values("t").groupby("u").cumcount()
    assert (got.set_index("t")["at"].sort_index().to_numpy() == want.set_axis(frame.sort_values("t")["t"]).sort_index().to_numpy()).all()
