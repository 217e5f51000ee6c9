"""Summaries over seasons, months, years, wards and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyria import config
from zephyria.catalog import sqltext as q
from zephyria.catalog.baselines import (
    METRIC_ROWS_SQL,
    PRED_SQL,
    REGRESSION_SQL,
    baseline_metrics,
    class_scores_sql,
    predictions,
)
from zephyria.catalog.column_queries import obs
from zephyria.catalog.registry import query
from zephyria.operators import aggregates as agg
from zephyria.operators import metrics, spatial
from zephyria.operators.columns import add_calendar, with_prefix
from zephyria.plans.daily import label_weather, score_health
from zephyria.functions import classes
from zephyria.sources import metrics_store, warehouse

g, r = q.g, q.r
DAILY = q.with_(q.OBS, q.DAILY)


def daily(spark, sf):
    return add_calendar(obs(spark, sf))


_POLL = {"click": "pm25", "view": "pm10", "purchase": "co", "signup": "no2", "error": "aqi"}


@query(
    "daily_mean",
    "select user_id as station_id, cast(ts as date) as date, "
    + ", ".join(f"{r(f'''avg(case when event_type='{k}' then value end)''', 6)} as {c}" for k, c in _POLL.items())
    + " from events group by 1, 2",
)
def daily_mean(spark, sf):
    raw = warehouse.feed_hourly(spark, sf)
    wide = raw.select(
        "station_id", "ts", *[F.when(F.col("pollutant") == k, F.col("value")).alias(c) for k, c in _POLL.items()]
    )
    return agg.daily_mean(wide, list(_POLL.values()))


def _long_stats(cols, by: str, extra: str, digits: int, where: str = "") -> str:
    return " union all ".join(
        f"""select {by}{', ' if by else ''}'{c}' as variable, {r(f'avg({c})', digits)} as mean, {r(f'stddev_samp({c})', digits)} as std,
 {r(f'min({c})', digits)} as min, {r(f'max({c})', digits)} as max, {extra.format(c=c)} from src {where} {f'group by {by}' if by else ''}"""
        for c in cols
    )


def _q(p: float, name: str, digits: int) -> str:
    return f"{r('quantile_cont({c}, ' + str(p) + ')', digits)} as {name}"


@query(
    "seasonal_stats",
    q.with_(q.OBS, q.DAILY, "src as (select * from daily where season <> 'Unknown')")
    + _long_stats(config.SEASONAL_COLUMNS, "season", _q(0.5, "median", 2), 2),
)
def seasonal_stats(spark, sf):
    return agg.seasonal_stats(daily(spark, sf))


def _means(cols, by: str, digits: int) -> str:
    return DAILY + f"select {by}, {', '.join(f'{r(f'avg({c})', digits)} as {c}' for c in cols)} from daily group by {by}"


@query("monthly_climatology", _means(config.MONTHLY_COLUMNS, "month", 2))
def monthly_climatology(spark, sf):
    return agg.monthly_climatology(daily(spark, sf))


@query("annual_mean", _means(config.TREND_COLUMNS, "year", 2))
def annual_mean(spark, sf):
    return agg.annual_means(daily(spark, sf))


@query(
    "annual_trend",
    q.with_(q.OBS, q.DAILY, "an as (" + _means(config.TREND_COLUMNS, "year", 2).removeprefix(DAILY) + ")")
    + "select *, "
    + ", ".join(f"{r(f'(select regr_slope({c}, year) from an)', 4)} as {c}_trend_slope" for c in config.TREND_COLUMNS)
    + " from an",
)
def annual_trend(spark, sf):
    return agg.annual_trend(daily(spark, sf))


@query(
    "temp_trend_line",
    q.with_(
        q.OBS,
        q.DAILY,
        f"an as (select year, {r('avg(temperature_mean)', 6)} as t from daily group by year)",
        "fit as (select regr_slope(t, year) as s, avg(t) as my, avg(year) as mx from an)",
    )
    + f"select year, {r('t', 6)} as temperature_mean, {r('my+s*(year-mx)', 6)} as trend from an, fit",
)
def temp_trend_line(spark, sf):
    return agg.trend_line(daily(spark, sf))


def _shares(risk_sql: str, levels) -> str:
    cells = ", ".join(
        f"""{r(f"count(*) filter (risk='{v}')*1e0/count(*)", 3)} as "{v}\"""" for v in levels
    )
    return DAILY + f"select season, {cells} from (select season, {risk_sql} as risk from daily) z group by season"


@query("flood_crosstab", _shares(q.flood_risk("rainfall", "humidity"), q.ORDINALS["flood_risk"]))
def flood_crosstab(spark, sf):
    return agg.flood_shares(label_weather(daily(spark, sf)))


@query("dengue_crosstab", _shares(q.dengue_risk("temperature_mean", "rainfall", "humidity"), q.ORDINALS["dengue_risk"]))
def dengue_crosstab(spark, sf):
    risk = classes.dengue_risk(F.col("temperature_mean"), F.col("rainfall"), F.col("humidity"))
    return agg.dengue_shares(daily(spark, sf).withColumn("dengue_risk", risk))


@query("aqi_month_trend", _means(["aqi"], "year, month", 1))
def aqi_month_trend(spark, sf):
    return agg.aqi_by_month(daily(spark, sf))


@query(
    "aqi_heatmap",
    DAILY
    + "select year, "
    + ", ".join(f'{r(f"coalesce(avg(aqi) filter (month={m}), 0e0)", 6)} as "{n}"' for m, n in enumerate(config.MONTH_NAMES, 1))
    + " from daily group by year",
)
def aqi_heatmap(spark, sf):
    return agg.aqi_matrix(daily(spark, sf))


_RAIN = f"ar as (select year, {g('coalesce(sum(rainfall), 0e0)')} as rainfall from daily group by year)"


@query("annual_rain", q.with_(q.OBS, q.DAILY, _RAIN) + "select * from ar")
def annual_rain(spark, sf):
    return agg.annual_rain(daily(spark, sf))


@query("avg_annual_rain", q.with_(q.OBS, q.DAILY, _RAIN) + f"select {r('avg(rainfall)', 6)} as avg_annual_rain from ar")
def avg_annual_rain(spark, sf):
    return agg.mean_annual_rain(daily(spark, sf))


@query("annual_pollutants", _means(config.POLLUTANT_COLUMNS, "year", 6))
def annual_pollutants(spark, sf):
    return agg.annual_pollutants(daily(spark, sf))


@query(
    "annual_uhi",
    q.with_(
        q.OBS,
        q.DAILY,
        f"an as (select year, {r('avg(temperature_mean)', 6)} as temperature_mean from daily group by year)",
        "base as (select avg(temperature_mean) as b from (select * from an order by year limit 5) z)",
    )
    + f"select year, temperature_mean, {g(q.clip('temperature_mean-b', 0))} as uhi from an, base",
)
def annual_uhi(spark, sf):
    return agg.annual_heat_island(daily(spark, sf))


_MONTH_NAME = "case month " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(config.MONTH_NAMES, 1)) + " end"


@query(
    "monthly_rain",
    DAILY + f"select month, {r('avg(rainfall)', 6)} as rainfall, {_MONTH_NAME} as month_name from daily group by month",
)
def monthly_rain(spark, sf):
    return agg.monthly_rain(daily(spark, sf))


@query(
    "kpi_overview",
    q.with_(q.OBS, q.DAILY, q.LAND, _RAIN)
    + f"""select {r('avg(temperature_mean)', 6)} as mean_temp, (select {r('avg(rainfall)', 6)} from ar) as avg_annual_rain,
 {r('avg(aqi)', 6)} as mean_aqi, (select arg_max(ndvi, year) from land) as ndvi_latest from daily""",
)
def kpi_overview(spark, sf):
    days = daily(spark, sf)
    return agg.kpi_overview(days, days, warehouse.landuse_year(spark, sf))


@query(
    "kpi_temp",
    DAILY
    + f"""select max(temperature_max) as max_temp, {r('avg(temperature_mean)', 6)} as mean_temp, min(temperature_min) as min_temp,
 count(*) filter (temperature_max > 40) as heat_wave_days from daily""",
)
def kpi_temp(spark, sf):
    return agg.kpi_temperature(daily(spark, sf))


@query(
    "kpi_rain",
    q.with_(q.OBS, q.DAILY, _RAIN)
    + f"""select (select {r('avg(rainfall)', 6)} from ar) as avg_annual_rain, max(rainfall) as max_rain,
 cast((count(*) filter (rainfall > 2.5e0)) // greatest(1, count(distinct year)) as bigint) as rainy_days_per_year,
 count(*) filter (rainfall > 64.4e0) as extreme_events from daily""",
)
def kpi_rain(spark, sf):
    return agg.kpi_rain(daily(spark, sf))


@query(
    "kpi_air",
    DAILY
    + f"""select {r('avg(aqi)', 6)} as mean_aqi, {r('avg(pm25)', 6)} as mean_pm25, {r('avg(no2)', 6)} as mean_no2,
 count(*) filter (aqi > 100) as poor_air_days from daily""",
)
def kpi_air(spark, sf):
    return agg.kpi_air(daily(spark, sf))


@query(
    "kpi_land",
    q.with_(q.LAND)
    + """select arg_min(built_up_pct, year) as built_up_pct_first, arg_max(built_up_pct, year) as built_up_pct_last,
 arg_min(ndvi, year) as ndvi_first, arg_max(ndvi, year) as ndvi_last from land""",
)
def kpi_land(spark, sf):
    return agg.kpi_land(warehouse.landuse_year(spark, sf))


_WARD_COLS = (*config.WARD_FEATURES, "lat", "lon")


@query(
    "ward_mean",
    q.with_(q.WARD) + f"select ward, {', '.join(f'{r(f'avg({c})', 6)} as {c}' for c in _WARD_COLS)} from ward group by ward",
)
def ward_mean(spark, sf):
    return spatial.ward_means(warehouse.ward_year(spark, sf))


@query(
    "uhi_hotspots",
    q.with_(
        q.WARD,
        f"wm as (select ward, {', '.join(f'{r(f'avg({c})', 6)} as {c}' for c in config.HOTSPOT_COLUMNS)} from ward group by ward)",
    )
    + f"""select *, cast(case when avg_temp >= (select {g('quantile_cont(avg_temp, 0.75)')} from wm) then 1 else 0 end as integer) as is_uhi_hotspot from wm""",
)
def uhi_hotspots(spark, sf):
    return spatial.heat_hotspots(warehouse.ward_year(spark, sf))


_LATEST = ("year", "lat", "lon", "avg_temp", "annual_rainfall", "avg_aqi", "ndvi", "buildup_pct", "flood_risk")


@query(
    "ward_latest",
    q.with_(q.WARD, "gap as (select * replace (case when year < 2000 then avg_aqi end as avg_aqi) from ward)")
    + f"select ward, {', '.join(f'arg_max({c}, year) filter ({c} is not null) as {c}' for c in _LATEST)} from gap group by ward",
)
def ward_latest(spark, sf):
    """Air quality is unknown from 2000 on, so its last known year differs."""
    wards = warehouse.ward_year(spark, sf)
    return spatial.ward_latest(wards.withColumn("avg_aqi", F.when(F.col("year") < 2000, F.col("avg_aqi"))))


@query(
    "ward_flood_point",
    q.with_(q.WARD)
    + f"""select ward, flood_risk, lat, lon, case flood_risk when 'Low' then '#3fb950' when 'Medium' then '#d29922' when 'High' then '#f78166' else '#8b949e' end as colour
 from (select ward, arg_max(flood_risk, year) as flood_risk, {r('avg(lat)', 6)} as lat, {r('avg(lon)', 6)} as lon from ward group by ward) z""",
)
def ward_flood_point(spark, sf):
    return spatial.ward_flood_point(warehouse.ward_year(spark, sf))


_RISKS = [f"risk_{k}" for k in config.HEALTH_WEIGHTS]
_RISK_LABELS = {
    "risk_heat_exhaustion": "Heat Exhaustion",
    "risk_dehydration": "Dehydration",
    "risk_respiratory": "Respiratory",
    "risk_flood_health": "Flood Health",
    "risk_dengue_vector": "Dengue Vector",
    "risk_sleep_disturb": "Sleep Disturb",
    "risk_productivity": "Productivity",
}
_SCORED = q.scored("obs", "sc", "station_id, date")


@query(
    "risk_profile",
    q.with_(
        q.OBS,
        *_SCORED,
        "rk as (select *, row_number() over (partition by station_id order by date desc) as n from sc)",
        "src as (select * from rk where n <= 365)",
    )
    + " union all ".join(
        f"select station_id, '{c}' as risk, {r(f'avg({c})', 6)} as mean_score, '{_RISK_LABELS[c]}' as label from src group by station_id"
        for c in _RISKS
    ),
)
def risk_profile(spark, sf):
    return agg.risk_profile(score_health(obs(spark, sf)))


@query(
    "seasonal_box",
    q.with_(q.OBS, q.DAILY)
    + f"""select season, 'humidity' as variable, count(humidity) as n, {r('avg(humidity)', 4)} as mean, {r('stddev_samp(humidity)', 4)} as std,
 {r('min(humidity)', 4)} as min, {r('max(humidity)', 4)} as max, {r('quantile_cont(humidity, 0.25)', 4)} as q1,
 {r('quantile_cont(humidity, 0.5)', 4)} as median, {r('quantile_cont(humidity, 0.75)', 4)} as q3
 from daily where humidity is not null group by season""",
)
def seasonal_box(spark, sf):
    return agg.seasonal_box(daily(spark, sf), "humidity")


@query(
    "risk_describe",
    q.with_(q.OBS, *_SCORED, "src as (select * from sc)")
    + _long_stats(
        (*_RISKS, "health_risk_score"),
        "",
        f"count({{c}}) as n, {_q(0.25, 'p25', 2)}, {_q(0.5, 'p50', 2)}, {_q(0.75, 'p75', 2)}",
        2,
    ),
)
def risk_describe(spark, sf):
    scored = score_health(obs(spark, sf))
    return agg.describe(scored, [*with_prefix(scored, "risk_"), "health_risk_score"])


@query(
    "landuse_share",
    q.with_(q.LAND)
    + " union all ".join(
        f"select year, '{c}' as land_class, {c} as share_pct, '{n}' as label from land" for c, n in config.LAND_CLASS_LABELS.items()
    ),
)
def landuse_share(spark, sf):
    return agg.land_shares(warehouse.landuse_year(spark, sf))


@query("ndvi_lst", q.with_(q.LAND) + "select year, ndvi, lst from land")
def ndvi_lst(spark, sf):
    return agg.greenness_and_heat(warehouse.landuse_year(spark, sf))


@query("regression_metrics", q.with_(q.OBS, *PRED_SQL) + f"select {REGRESSION_SQL} from pred")
def regression_metrics(spark, sf):
    return metrics.regression_metrics(predictions(spark, sf))


_CLASSED = "pc as (select actual_class as a, predicted_class as p from pred)"


@query("classification_metrics", q.with_(q.OBS, *PRED_SQL, _CLASSED) + f"select * from {class_scores_sql('pc')} z")
def classification_metrics(spark, sf):
    return metrics.classification_metrics(predictions(spark, sf), "actual_class", "predicted_class")


@query(
    "confusion_matrix",
    q.with_(q.OBS, *PRED_SQL, "labels as (select actual_class as l from pred union select predicted_class from pred)")
    + """select x.l as actual, y.l as predicted, cast(count(p.date) as bigint) as n from labels x cross join labels y
 left join pred p on p.actual_class = x.l and p.predicted_class = y.l group by 1, 2""",
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(predictions(spark, sf), "actual_class", "predicted_class")


@query("model_compare", f'select model, "RMSE" from ({METRIC_ROWS_SQL}) z where "RMSE" is not null')
def model_compare(spark, sf):
    return metrics_store.compare(baseline_metrics(spark, sf), "RMSE")


@query(
    "tail_mean",
    q.with_(q.OBS, "rk as (select *, row_number() over (partition by station_id order by date desc) as n from obs)")
    + f"""select station_id, {r('avg(humidity)', 6)} as humidity_mean, {r('avg(pressure)', 6)} as pressure_mean from rk where n <= 30 group by 1""",
)
def tail_mean(spark, sf):
    return agg.tail_means(obs(spark, sf))
