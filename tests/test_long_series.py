"""Bucketed series operators against the window forms, and how one series spreads over tasks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyria.operators import gaps, long_series, windows

START = dt.date(2020, 1, 1)
COLS = ["x", "y"]


@pytest.fixture(scope="module")
def rows(spark):
    """Series with missing days, whole months without values, one short, one of nulls, one with a null key."""
    rng = np.random.default_rng(11)
    data = []
    for station, n in ((1, 400), (2, 3), (3, 90), (None, 200)):
        day = 0
        for i in range(n):
            day += int(rng.integers(1, 4)) if station != 3 else 1
            known = rng.random() < 0.6 and not 100 <= i < 180 and station != 3
            x = float(rng.integers(0, 40)) if known else None
            data.append((station, START + dt.timedelta(days=day), x if x is None or rng.random() > 0.02 else 900.0, float(i % 7)))
    return spark.createDataFrame(data, "station_id long, date date, x double, y double").repartition(4).cache()


def _same(got, want):
    assert got.columns == want.columns
    order = [F.col("station_id").asc_nulls_first(), "date"]
    a, b = (df.orderBy(*order).collect() for df in (got, want))
    assert len(a) == len(b)
    for r, s in zip(a, b):
        for u, v in zip(r, s):
            assert u == v or u == pytest.approx(v, rel=1e-12), (r, s)


PAIRS = {
    "fill": (lambda m, d: m.fill_nearest(d)),
    "both": (lambda m, d: m.interpolate(d)),
    "forward": (lambda m, d: m.interpolate(d, leading=False)),
    "outliers": (lambda m, d: m.clean_series(d, COLS)),
}


@pytest.mark.parametrize("name", PAIRS)
def test_gaps_equal_the_window_form(rows, name):
    _same(PAIRS[name](long_series, rows), PAIRS[name](gaps, rows))


ROLLED = {
    "mean": (lambda m, d, **k: m.rolling_mean(d, {"r": ("x", 7, 2), "q": ("y", 3, 2)}, **k)),
    "anomaly": (lambda m, d, **k: m.rolling_anomaly(d, "x", "r", 12, **k)),
    "lag": (lambda m, d, **k: m.lag_filled(d, {"r": ("x", 1), "q": ("y", 7)}, **k)),
    "sequences": (lambda m, d, **k: m.sequences(d, ["y"], "x", 9, **k)),
}


@pytest.mark.parametrize("block_rows", [1, 10, 37, 65536])
@pytest.mark.parametrize("name", ROLLED)
def test_rolled_equal_the_window_form(rows, name, block_rows):
    _same(ROLLED[name](long_series, rows, block_rows=block_rows), ROLLED[name](windows, rows))


def test_running_and_split_equal_the_window_form(rows):
    key = (["station_id"], "date")
    _same(long_series.running_max(rows, "x", "m", *key), windows.running_max(rows, "x", "m", *key))
    _same(long_series.loss_since_first(rows, "x", "m", *key), windows.loss_since_first(rows, "x", "m", *key))
    _same(long_series.temporal_split(rows), windows.temporal_split(rows))


def test_figures_of_buckets_are_shuffled_once_a_pass(rows):
    """Not once for each window over them: two for any number of columns (rows by bucket, figures by series and back)."""
    wide = rows.withColumns({f"z{i}": F.col("y") + i for i in range(5)})
    cols = [f"z{i}" for i in range(5)]
    for op in (lambda d, c: long_series.blank_outliers(d, c), lambda d, c: long_series.fill_nearest(d, c)):
        plans = [op(wide, c)._jdf.queryExecution().executedPlan().toString() for c in (cols[:1], cols)]
        one, five = (p.count("Exchange hashpartitioning") for p in plans)
        assert one == five <= 4, plans[1]


def test_no_rows(spark, rows):
    none = rows.where("false")
    for op in (*PAIRS.values(), *ROLLED.values()):
        assert op(long_series, none).count() == 0


def test_one_series_is_many_tasks(spark):
    """Two million minutes of one station: no task holds more than a few of its buckets."""
    n = 2_000_000
    base = spark.range(n).select(
        F.lit(1).alias("station_id"),
        F.timestamp_seconds(F.col("id") * 60).alias("date"),
        F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).alias("x"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        filled = long_series.interpolate(base, ["x"])
        tasks = filled.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("x") - F.unix_timestamp("date") / 60)).alias("off")
        ).collect()
        rolled = long_series.rolling_mean(base, {"r": ("x", 30, 2)}, block_rows=10_000)
        blocks = [r.n for r in rolled.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n for r in tasks) == n and max(r.n for r in tasks) < n / 3
    assert sum(r.off for r in tasks) < 9 * 10  # the last gap repeats its value
    assert sum(blocks) == n and max(blocks) < n / 3
