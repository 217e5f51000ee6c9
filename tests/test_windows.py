import numpy as np
import pandas as pd
import pytest
from frames import column, series

from zephyria.operators import spatial, windows

N = None


def _list(s, digits):
    return [None if pd.isna(v) else float(np.round(v, digits)) for v in s]


@pytest.mark.parametrize("n", [7, 30])
def test_rolling_mean_skips_missing(spark, n):
    values = [N, 1.0, 2.0, N, 5.0] + [float(i * i % 17) for i in range(60)]
    got = column(windows.rolling_mean(series(spark, {"x": values}), {"m": ("x", n, 2)}), "m")
    assert got == _list(pd.Series(values, dtype=float).rolling(n, min_periods=1).mean(), 2)


def test_anomaly_rules(spark):
    values = [4.0, 4.0, 6.0, N] + [5.0] * 31 + [9.0]
    got = column(windows.rolling_anomaly(series(spark, {"x": values}), "x", "z"), "z")
    assert got[0] == 0.0  # a single value
    assert got[1] is None  # constant window of two
    assert got[2] == round((6 - 14 / 3) / pd.Series([4.0, 4.0, 6.0]).std(), 3)
    assert got[3] is None  # missing itself
    assert got[34] is None  # thirty equal values
    assert got[35] == pytest.approx((9 - pd.Series(values[6:36]).mean()) / pd.Series(values[6:36]).std(), abs=1e-3)


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0], [N, 2.0, 3.0, N, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0], [N, N], [1.0]])
@pytest.mark.parametrize("k", [1, 7])
def test_lags_are_backfilled(spark, values, k):
    got = column(windows.lag_filled(series(spark, {"x": values}), {"l": ("x", k)}), "l")
    want = pd.Series(values, dtype=float).shift(k).bfill()
    assert got == _list(want, 6)


@pytest.mark.parametrize("n, sequences", [(29, 0), (30, 0), (31, 1), (100, 70)])
def test_sequence_count_and_order(spark, n, sequences):
    df = series(spark, {"x": [float(i) for i in range(n)]})
    rows = windows.sequences(df, ["x"], "x").orderBy("date").collect()
    assert len(rows) == sequences
    for row in rows:
        assert [s["x"] for s in row["steps"]] == [row["target"] - 30 + i for i in range(30)]


def test_sequences_count_after_dropping_gaps(spark):
    values = [float(i) if i % 3 else N for i in range(60)]
    assert windows.sequences(series(spark, {"x": values}), ["x"], "x").count() == 40 - 30


@pytest.mark.parametrize("n", [1, 10, 100, 133])
def test_split_is_chronological(spark, n):
    got = column(windows.temporal_split(series(spark, {"x": [0.0] * n})), "split")
    a, b = int(n * 0.70), int(n * 0.85)
    assert got == ["train"] * a + ["validation"] * (b - a) + ["test"] * (n - b)


def test_yearly_operators(spark):
    rows = [("all", 2000 + i, v, v * 10, 100 - v, w) for i, (v, w) in enumerate([(1.0, 8.0), (3.0, 6.0), (2.0, 7.0), (2.5, 4.0)])]
    land = spark.createDataFrame(rows, "region_id string, year int, ndvi double, built_up_pct double, vegetation_pct double, water_pct double")
    loss = spatial.water_loss(land)
    assert column(loss, "water_loss_pct", "year") == [0.0, 25.0, 12.5, 50.0]
    worst = column(loss, "cumulative_loss", "year")
    assert worst == [0.0, 25.0, 25.0, 50.0] and worst == sorted(worst)
    assert column(spatial.yearly_change(land), "ndvi_change", "year") == [0.0, 2.0, -1.0, 0.5]


def test_running_max_leaves_missing_rows_missing(spark):
    df = series(spark, {"x": [1.0, N, 0.5, 3.0]})
    assert column(windows.running_max(df, "x", "m", ["station_id"], "date"), "m") == [1.0, None, 1.0, 3.0]
