"""Scans, feeds and sinks: files are landed from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyria.catalog import landing
from zephyria.catalog.baselines import METRIC_ROWS_SQL, baseline_metrics
from zephyria.catalog.registry import query
from zephyria.catalog.sqltext import AIR, CALENDAR, OBS, WARD, WEATHER, g, with_
from zephyria.functions.numeric import guard
from zephyria.operators.ordering import date_spine
from zephyria.session import scratch_path
from zephyria.sources import feeds, schemas, warehouse
from zephyria.sources.metrics_store import read_metrics, read_stored, write_metrics
from zephyria.sources.tables import current, scan, scan_first, scan_wards, write_table

_WEATHER_SQL = (
    with_(OBS)
    + f"""select station_id, date, {', '.join(WEATHER)}, temperature_mean as apparent_temp, so2 as solar,
 {CALENDAR} from obs"""
)


@query("scan_csv", _WEATHER_SQL)
def scan_csv(spark, sf):
    """The file has its columns in another order than the table, and one that the table has not."""
    weather = landing.full_weather(spark, sf)
    stored = weather.select(*sorted(weather.columns, reverse=True), F.lit("x").alias("note"))
    return scan(spark, landing.land_csv(spark, stored, "weather-csv"), schemas.WEATHER)


@query("scan_fallback", with_(OBS) + f"select station_id, date, {', '.join(AIR)} from obs")
def scan_fallback(spark, sf):
    """Only the last of the candidate paths exists."""
    path = landing.land_csv(spark, landing.full_air(spark, sf), "air-csv")
    missing = [(scratch_path(spark, f"absent-{i}"), schemas.AIR) for i in range(3)]
    return scan_first(spark, [*missing, (path, schemas.AIR)])


@query(
    "scan_ward",
    with_(WARD)
    + "select year, ward, lat, lon, avg_temp, annual_rainfall, avg_aqi, ndvi, buildup_pct, flood_risk from ward",
)
def scan_ward(spark, sf):
    """Ward files have the population last, and need not have every label."""
    wards = landing.full_wards(spark, sf)
    stored = wards.select(*[c for c in wards.columns if c not in ("population_den", "dengue_risk")], "population_den")
    path = landing.land_csv(spark, stored, "ward-csv")
    return scan_wards(spark, path).drop("population_den", "health_risk", "dengue_risk")


@query(
    "json_daily_arrays",
    with_(OBS)
    + """select station_id, date, temperature_max, temperature_min, temperature_mean, rainfall, wind_speed,
 temperature_mean as apparent_temp from obs""",
)
def json_daily_arrays(spark, sf):
    return feeds.daily_feed(spark, landing.daily_feed(spark, sf))


@query(
    "json_param_map",
    with_(OBS)
    + f"select station_id, date, humidity, {g('pressure/10e0*10e0')} as pressure, so2 as solar from obs",
)
def json_param_map(spark, sf):
    rows = feeds.clean_parameters(feeds.parameter_feed(spark, landing.parameter_feed(spark, sf)))
    return rows.withColumn("pressure", guard(F.col("pressure")))


HOURLY_SQL = """hourly as (select user_id as station_id, date_trunc('hour', ts) as ts,
 avg(case when event_type='click' then value end) as pm25, avg(case when event_type='view' then value end) as pm10,
 avg(case when event_type='purchase' then value end) as co_raw, avg(case when event_type='signup' then value end) as no2,
 avg(case when event_type='error' then value end) as aqi from events group by 1, 2)"""
_POLLUTANTS = ("pm25", "pm10", "no2", "aqi")


@query(
    "json_hourly_arrays",
    with_(HOURLY_SQL)
    + f"""select station_id, cast(ts as date) as date, cast(hour(ts) as integer) as hour,
 {', '.join(f'{g(c)} as {c}' for c in _POLLUTANTS)}, {g('co_raw')} as co from hourly""",
)
def json_hourly_arrays(spark, sf):
    rows = feeds.hourly_feed(spark, landing.hourly_feed(spark, sf))
    return rows.select(
        "station_id",
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hour"),
        *[guard(F.col(c)).alias(c) for c in (*_POLLUTANTS, "co")],
    )


@query("metrics_table", METRIC_ROWS_SQL)
def metrics_table(spark, sf):
    """Metrics of the baseline predictors, stored as JSON and read as a flat table."""
    path = scratch_path(spark, "metrics")
    write_metrics(baseline_metrics(spark, sf), path)
    return read_metrics(spark, path)


@query(
    "write_table",
    with_(OBS, f"d as (select station_id, date, aqi, {CALENDAR} from obs)")
    + "select station_id, date, aqi, season, year from d",
)
def write_table_query(spark, sf):
    """Written by year and read back whole."""
    path = scratch_path(spark, "daily-table")
    daily = warehouse.add_calendar(warehouse.obs_daily(spark, sf).select("station_id", "date", "aqi"))
    write_table(daily.select("station_id", "date", "aqi", "season", "year"), path)
    return spark.read.parquet(current(spark, path)).select("station_id", "date", "aqi", "season", "year")


@query("write_metrics", METRIC_ROWS_SQL.replace("select model, task,", "select model,"))
def write_metrics_query(spark, sf):
    path = scratch_path(spark, "metrics-sink")
    write_metrics(baseline_metrics(spark, sf), path)
    return read_stored(spark, path).select("model", *schemas.NUMERIC_METRICS)


@query(
    "date_spine",
    with_(OBS, "span as (select year(min(date)) as a, year(max(date)) as b from obs)")
    + """select s.date, cast(count(o.date) as bigint) as n_rows
 from (select cast(unnest(generate_series(make_date(a,1,1), make_date(b,12,31), interval 1 day)) as date) as date from span) s
 left join obs o on o.date = s.date group by s.date""",
)
def date_spine_query(spark, sf):
    return date_spine(warehouse.obs_daily(spark, sf))
