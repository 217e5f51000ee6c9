import pytest
from frames import scalars
from pyspark.sql import functions as F

from zephyria.functions import classes

E = 1e-6


@pytest.mark.parametrize(
    "fn, cases",
    [
        (
            classes.temperature_class,
            {0: "Normal", -E: "Heat-Wave", 30 - E: "Normal", 30: "Hot", 35 - E: "Hot", 35: "Very Hot", 40: "Heat-Wave",
             998.9: "Heat-Wave", 999: "Heat-Wave", -5: "Heat-Wave", None: "Heat-Wave"},
        ),
        (
            classes.rainfall_class,
            {0: "No Rain", 0.1 - E: "No Rain", 0.1: "Light", 7.5: "Moderate", 35.5: "Heavy", 64.4: "Extreme",
             64.4 - E: "Heavy", 9999: "Extreme", -1: "Extreme", None: "Extreme"},
        ),
        (
            classes.aqi_class,
            {0: "Good", 50: "Good", 50.5: "Very Poor", 51: "Moderate", 100: "Moderate", 100.5: "Very Poor", 101: "Poor",
             200: "Poor", 200.5: "Very Poor", 201: "Very Poor", -1: "Very Poor", None: "Very Poor"},
        ),
        (
            lambda c: classes.aqi_class(c, contiguous=True),
            {50.5: "Good", 100.5: "Moderate", 200.5: "Poor", 201: "Very Poor"},
        ),
        (
            classes.risk_label,
            {25 - E: "Low", 25: "Moderate", 50: "High", 75 - E: "High", 75: "Severe", None: "Severe", -3: "Low"},
        ),
    ],
)
def test_band_edges(spark, fn, cases):
    values = [None if v is None else float(v) for v in cases]
    assert scalars(spark, lambda x: fn(F.col(x)), values) == list(cases.values())


def _three(spark, fn, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("a"), F.col("b"), F.col("c"))).collect()]


def test_flood_risk_edges(spark):
    out = _three(
        spark,
        lambda r, h, _: classes.flood_risk(r, h),
        [(0.0, 49.9, 0.0), (0.0, 50.0, 0.0), (30.0, 80.0, 0.0), (30.0, 79.9, 0.0), (None, 50.0, 0.0)],
    )
    assert out == ["Low", "Medium", "High", "Medium", "High"]


def test_dengue_points(spark):
    out = _three(
        spark,
        classes.dengue_risk,
        [(25.0, 11.0, 71.0), (35.0, 11.0, 70.0), (24.9, 10.0, 71.0), (30.0, 0.0, 71.0), (None, None, None)],
    )
    assert out == ["High", "High", "Low", "Medium", "Low"]


def test_health_risk_of_missing_input_is_worst(spark):
    out = _three(spark, classes.health_risk, [(0.0, 0.0, 0.0), (45.0, 500.0, 100.0), (20.0, None, 50.0)])
    assert out == ["Low", "Severe", "Severe"]


def test_codes_of_unknown_labels(spark):
    labels = ["Good", "Very Poor", "Hazardous", None]
    assert scalars(spark, lambda x: classes.aqi_ordinal(F.col(x)), labels, "string") == [0, 3, 1, 1]
    assert scalars(spark, lambda x: classes.season_code(F.col(x)), ["Summer", "Unknown", None], "string") == [1, 0, 0]
    assert scalars(spark, lambda x: classes.risk_ordinal("rain_class", F.col(x)), ["Extreme", "?"], "string") == [4, 0]
