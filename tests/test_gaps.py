import numpy as np
import pandas as pd
import pytest
from frames import column, series
from pyspark.sql import functions as F

from zephyria.operators import gaps

N = None
SHAPES = {
    "head": [N, N, 3.0, 4.0, 9.0],
    "middle": [1.0, N, N, 4.0, N, 10.0],
    "tail": [1.0, 2.0, N, N],
    "all": [N, N, N],
    "one": [5.0],
    "one missing": [N],
    "full": [1.0, 2.0, 4.0],
}


def _pandas(values):
    return pd.Series(values, dtype="float64")


def _list(s):
    return [None if np.isnan(v) else float(v) for v in s]


@pytest.mark.parametrize("shape", SHAPES)
def test_fills_match_pandas(spark, shape):
    values = SHAPES[shape]
    df = series(spark, {"x": values})
    s = _pandas(values)
    both = column(gaps.interpolate(df), "x")
    assert both == pytest.approx(_list(s.interpolate(method="linear", limit_direction="both")), nan_ok=True)
    assert column(gaps.interpolate(df, backward_first=True), "x") == both
    assert column(gaps.interpolate(df, leading=False), "x") == pytest.approx(_list(s.interpolate()))
    assert column(gaps.fill_nearest(df), "x") == _list(s.ffill().bfill())


def test_two_stations_do_not_mix(spark):
    df = series(spark, {"x": [1.0, N, 3.0]}, 1).union(series(spark, {"x": [N, 10.0, N]}, 2))
    assert column(gaps.interpolate(df), "x") == [1.0, 2.0, 3.0, 10.0, 10.0, 10.0]


def _clean_pandas(values, limit=3.5):
    s = _pandas(values).interpolate(limit_direction="both")
    z = ((s - s.mean()) / (s.std() + 1e-9)).abs()
    return s.mask(z > limit).interpolate(limit_direction="both")


@pytest.mark.parametrize(
    "values",
    [
        [10.0] * 19 + [1000.0],
        [float(i % 5) for i in range(30)] + [500.0] + [float(i % 5) for i in range(30)],
        [7.0] * 12,
        [3.0],
        [N, 1.0, 2.0] + [1.5] * 30 + [N, 99.0, N],
    ],
)
def test_outliers_match_pandas(spark, values):
    df = series(spark, {"x": values})
    assert column(gaps.clean_series(df, ["x"]), "x") == pytest.approx(_list(_clean_pandas(values)))


def test_result_does_not_depend_on_layout(spark):
    rng = np.random.default_rng(3)
    frames = [
        series(spark, {"x": [None if rng.random() < 0.3 else float(rng.integers(0, 50)) for _ in range(60)]}, k)
        for k in range(5)
    ]
    df = frames[0]
    for f in frames[1:]:
        df = df.union(f)
    base = column(gaps.clean_series(df, ["x"]), "x")
    for parts in (1, 3, 13):
        assert column(gaps.clean_series(df.orderBy(F.rand(parts)).repartition(parts), ["x"]), "x") == base
