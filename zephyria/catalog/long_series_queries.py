"""The series operators in bucketed form, held against the same SQL as the window forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyria.catalog.column_queries import KEY, WEATHER, obs
from zephyria.catalog.registry import ORACLES, query
from zephyria.catalog.window_queries import _SEQ, _rolled, summarised
from zephyria.operators import long_series
from zephyria.operators.spatial import REGION
from zephyria.sources import warehouse

LAGGED = {"temperature_mean_lag7": ("temperature_mean", 7), "humidity_lag7": ("humidity", 7)}


@query("long_ffill_bfill", ORACLES["ffill_bfill"])
def long_ffill_bfill(spark, sf):
    return long_series.fill_nearest(obs(spark, sf).select(*KEY, "humidity", "wind_speed"))


@query("long_interp_both", ORACLES["interp_both"])
def long_interp_both(spark, sf):
    return long_series.interpolate(obs(spark, sf).select(*KEY, "humidity", "wind_speed"))


@query("long_outlier_blank", ORACLES["outlier_blank"])
def long_outlier_blank(spark, sf):
    return long_series.clean_series(obs(spark, sf).select(*KEY, *WEATHER), WEATHER)


@query("long_roll_30", ORACLES["roll_30"])
def long_roll_30(spark, sf):
    return long_series.rolling_mean(obs(spark, sf), _rolled(30)).select(*KEY, *_rolled(30))


@query("long_rainfall_anomaly", ORACLES["rainfall_anomaly"])
def long_rainfall_anomaly(spark, sf):
    return long_series.rolling_anomaly(obs(spark, sf).select(*KEY, "rainfall"), "rainfall", "rainfall_anomaly")


@query("long_lag_7", ORACLES["lag_7"])
def long_lag_7(spark, sf):
    return long_series.lag_filled(obs(spark, sf), LAGGED).select(*KEY, *LAGGED)


@query("long_make_sequences", ORACLES["make_sequences"])
def long_make_sequences(spark, sf):
    return summarised(long_series.sequences(obs(spark, sf), _SEQ, "temperature_mean"))


@query("long_cumulative_loss", ORACLES["cumulative_loss"])
def long_cumulative_loss(spark, sf):
    land, decade = warehouse.landuse_year(spark, sf), F.floor(F.col("year") / 10)
    lost = long_series.loss_since_first(land, "water_pct", "water_loss_pct", REGION, "year", decade)
    peak = long_series.running_max(lost, "water_loss_pct", "cumulative_loss", REGION, "year", decade)
    return peak.select("year", "water_pct", "water_loss_pct", "cumulative_loss")


@query("long_temporal_split", ORACLES["temporal_split"])
def long_temporal_split(spark, sf):
    return long_series.temporal_split(obs(spark, sf).select(*KEY))
