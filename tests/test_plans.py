"""The physical plans the engine relies on at scale."""

import re

import pytest

from zephyria.catalog import QUERIES
from zephyria.plans import daily
from zephyria.sources import warehouse

# no file is written by these, so the plan reaches down to the tables
LAZY = ["health_risks", "clean_met", "clean_aqi", "merge_daily", "engineer_features", "seasonal_stats", "annual_trend",
        "risk_profile", "join_met_aqi", "uhi_hotspots", "make_sequences", "regression_metrics", "tail_n", "minmax_scale"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for node in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, f"{node} in the plan of {name}"


@pytest.mark.parametrize("name", ["clean_met", "clean_aqi", "merge_daily", "engineer_features", "make_sequences"])
def test_daily_windows_are_spread_by_station(spark, sf_dir, name):
    assert "Exchange SinglePartition" not in plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["outlier_blank", "clean_aqi", "long_interp_both", "long_ffill_bfill"])
def test_tasks_of_windows_are_bounded_by_bytes(spark, sf_dir, name):
    """Rows are dealt finely, however few partitions the session asks for, and put together up to a size."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        counts = re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan_of(QUERIES[name](spark, sf_dir)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert counts and min(map(int, counts)) >= 256
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("32m", "33554432b")


def test_scoring_adds_no_shuffle(spark, sf_dir):
    """The only exchange is the daily collapse of the raw readings."""
    assert plan_of(QUERIES["health_risks"](spark, sf_dir)).count("Exchange ") == 1


def test_cleaning_shuffles_once(spark, sf_dir, tmp_path):
    warehouse.met_daily(spark, sf_dir).write.parquet(f"{tmp_path}/met")
    warehouse.aqi_daily(spark, sf_dir).write.parquet(f"{tmp_path}/aqi")
    met, aqi = spark.read.parquet(f"{tmp_path}/met"), spark.read.parquet(f"{tmp_path}/aqi")
    assert plan_of(daily.clean_weather(met)).count("Exchange ") == 1
    whole = plan_of(daily.engineer_features(daily.merge_daily(daily.clean_weather(met), daily.clean_air(aqi))))
    assert whole.count("Exchange ") == 2  # one per input, none for the join or the later windows
    assert "SortMergeJoin" in whole and whole.count("+- Sort ") == 7  # three per cleaning, one for the lags


def test_scan_reads_only_needed_columns(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        schema = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES["roll_30"](spark, sf_dir)))[0]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "l_quantity" in schema
    assert "l_extendedprice" not in schema and "l_linestatus" not in schema


def test_no_frame_looks_ahead_without_bound(spark, sf_dir):
    """A current-row-to-end frame costs quadratic time; the series is walked backwards instead."""
    plan = plan_of(QUERIES["engineer_features"](spark, sf_dir)).lower()
    assert not re.search(r"currentrow\$\(\), unboundedfollowing", plan)
