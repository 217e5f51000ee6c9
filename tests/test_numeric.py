import math

import numpy as np
import pandas as pd
from frames import scalars
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zephyria import config
from zephyria.functions import health, indicators
from zephyria.functions.numeric import clip, no_nan, rnd
from zephyria.functions.text import fixed
from zephyria.sources.feeds import co_to_mg
from zephyria.sources.tables import nan_to_null


def test_rounding_is_half_even_like_array_libraries(spark):
    values = [0.005, 0.015, 0.025, 2.675, -0.005, -0.004, 1e15 + 0.5, None]
    got = scalars(spark, lambda x: rnd(F.col(x), 2), values)
    want = [None if v is None else float(np.round(v, 2)) + 0.0 for v in values]
    assert got == want
    assert math.copysign(1, got[5]) == 1  # never a negative zero


def test_rounding_ignores_summation_noise(spark):
    assert scalars(spark, lambda x: rnd(F.col(x), 2), [0.125 + 1e-13, 0.125 - 1e-13]) == [0.12, 0.12]


def test_clip_keeps_missing(spark):
    assert scalars(spark, lambda x: clip(F.col(x), 0, 10), [-1.0, 5.0, 11.0, None]) == [0.0, 5.0, 10.0, None]
    assert scalars(spark, lambda x: clip(F.col(x), lo=0), [-1.0, 99.0, None]) == [0.0, 99.0, None]


def test_nan_becomes_null(spark):
    assert scalars(spark, lambda x: no_nan(F.col(x)), [float("nan"), 1.0, None]) == [None, 1.0, None]
    df = spark.createDataFrame([(1, float("nan"), "a")], "i int, x double, s string")
    assert nan_to_null(df).collect()[0] == (1, None, "a")


def test_zero_gas_reading_is_missing(spark):
    assert scalars(spark, lambda x: co_to_mg(F.col(x)), [0.0, 500.0, None]) == [None, 0.5, None]


def test_fixed_text(spark):
    assert scalars(spark, lambda x: fixed(F.col(x), 1, "%"), [12.34, None]) == ["12.3%", None]


finite = st.floats(-50, 500, allow_nan=False)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.one_of(st.none(), finite)] * 7), min_size=1, max_size=40))
def test_scores_stay_in_range(spark, rows):
    names = list(config.ABSENT_HEALTH_INPUTS)
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    scores = health.risk_scores({n: F.col(n) for n in names})
    out = df.select(*[c.alias(k) for k, c in scores.items()])
    total = out.withColumn("total", health.composite({k: F.col(k) for k in scores}))
    for row in total.collect():
        for value in row:
            assert value is None or 0 <= value <= 100


def test_health_scores_against_array_formulas(spark):
    rng = np.random.default_rng(7)
    n = 200
    pdf = pd.DataFrame(
        {
            "temperature_mean": rng.uniform(10, 45, n),
            "temperature_min": rng.uniform(5, 30, n),
            "humidity": rng.uniform(10, 100, n),
            "wind_speed": rng.uniform(0, 60, n),
            "rainfall": rng.uniform(0, 120, n),
            "aqi": rng.uniform(0, 600, n),
            "pm25": rng.uniform(0, 400, n),
        }
    ).round(3)
    got = spark.createDataFrame(pdf).select(
        *[c.alias(k) for k, c in health.risk_scores({c: F.col(c) for c in pdf}).items()]
    ).toPandas()
    t, rh = pdf.temperature_mean, pdf.humidity
    felt = t + 0.33 * (rh / 100 * 6.105 * np.exp(17.27 * t / (237.7 + t))) - 4
    want_heat = ((felt - 27) / 20 * 100).clip(0, 100).round(1)
    want_work = (((t - 28) / 15 * 60).clip(0, 60) + (pdf.aqi / 500 * 40).clip(0, 40)).clip(0, 100).round(1)
    assert np.allclose(got.heat_exhaustion, want_heat, atol=0.1 + 1e-9) and (got.heat_exhaustion == want_heat).mean() > 0.99
    assert (got.productivity == want_work).mean() > 0.99


def test_heat_index_only_above_threshold(spark):
    df = spark.createDataFrame([(27.0, 60.0), (27.1, 60.0), (20.0, None), (30.0, None), (None, 50.0)], "t double, h double")
    out = [r[0] for r in df.select(indicators.heat_index(F.col("t"), F.col("h"))).collect()]
    f = 27.1 * 9 / 5 + 32
    hi = (
        -42.379 + 2.04901523 * f + 10.14333127 * 60 - 0.22475541 * f * 60 - 0.00683783 * f**2 - 0.05481717 * 3600
        + 0.00122874 * f**2 * 60 + 0.00085282 * f * 3600 - 0.00000199 * f**2 * 3600
    )
    assert out == [27.0, round((hi - 32) * 5 / 9, 2), 20.0, None, None]


def test_ramp_colour_ends_and_constant(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (None,)], "v double")
    out = [r[0] for r in df.select(indicators.ramp_colour(F.col("v"), F.lit(0.0), F.lit(1.0))).collect()]
    # channels are truncated and the range has a small epsilon: the top is fe, not ff
    assert out == ["#0040ff", "#fe4000", "#7f407f", None]
    flat = spark.createDataFrame([(3.0,)], "v double")
    assert flat.select(indicators.ramp_colour(F.col("v"), F.lit(3.0), F.lit(3.0))).collect()[0][0] == "#0040ff"
