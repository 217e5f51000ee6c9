import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from zephyria.operators.quantiles import brackets, quantiles

PROBS = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
groups = st.dictionaries(
    st.sampled_from("abc"),
    st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60),
    min_size=1,
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups, st.sampled_from([1000, 10_000]))
def test_quantiles_match_numpy(spark, data, accuracy):
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    got = {r["k"]: r for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "v", PROBS, ["k"], accuracy).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        for name, p in PROBS.items():
            assert np.isclose(got[k][name], np.quantile(vs, p), rtol=1e-9, atol=1e-6)


def test_one_value_holding_a_third_and_missing_values(spark):
    rng = np.random.default_rng(1)
    values = [7.0] * 3000 + list(rng.normal(0, 1e4, 6000).round(3))
    rows = [(float(v),) for v in values] + [(None,)] * 50
    got = quantiles(spark.createDataFrame(rows, "v double"), "v", {"q1": 0.25, "median": 0.5}).collect()
    assert len(got) == 1
    assert np.isclose(got[0]["q1"], np.quantile(values, 0.25)) and np.isclose(got[0]["median"], np.quantile(values, 0.5))


def test_constant_group(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "v double")
    assert quantiles(df, "v", PROBS).collect()[0].asDict() == {k: 5.0 for k in PROBS}


def test_heavy_tails_and_outliers_do_not_widen_a_bracket(spark):
    """What is ordered in one task stays a small share of the rows, whatever the values."""
    rng, n, accuracy = np.random.default_rng(2), 40_000, 100
    columns = {
        "lognormal": np.exp(rng.normal(0, 6, n)),
        "outlier": np.append(rng.normal(20, 5, n - 1), 1e12),
        "flat": rng.uniform(0, 1, n),
    }
    rows = spark.createDataFrame([(k, float(v)) for k, vs in columns.items() for v in vs], "k string, v double").cache()
    got = {r["k"]: r for r in quantiles(rows, "v", PROBS, ["k"], accuracy).collect()}
    for k, vs in columns.items():
        for name, p in PROBS.items():
            assert np.isclose(got[k][name], np.quantile(vs, p), rtol=1e-9)
    sizes = brackets(rows, "v", PROBS, ["k"], accuracy, False).groupBy("k", "_i").agg(F.sum("_n").alias("n"))
    assert sizes.agg(F.max("n")).collect()[0][0] <= 7 * n / accuracy


def test_values_outside_the_brackets_do_not_move(spark):
    """Rows that the shuffle of counted values gets: the brackets' share, not the table."""
    n = 200_000
    df = spark.range(0, n, 1, 4).select((F.col("id") % 4).alias("g"), F.xxhash64("id").cast("double").alias("v"))
    ordered = brackets(df, "v", {"a": 0.25, "b": 0.75}, ["g"], 10_000, True)
    rows = ordered.agg(F.count("*").alias("rows"), F.max("_total").alias("total")).first()
    assert rows["total"] == n // 4 and rows["rows"] < n * 2 * 6 / 10_000 + 100
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    counted = [line for line in plan.splitlines() if "keys=[g" in line and "_under" in line and "partial_count" in line]
    assert counted, plan
