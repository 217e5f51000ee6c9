"""Cleaning, merging, feature and report jobs from end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyria import config
from zephyria.catalog import aggregate_queries, landing, window_queries  # noqa: F401  (their SQL is reused)
from zephyria.catalog import sqltext as q
from zephyria.catalog.column_queries import KEY, obs
from zephyria.catalog.registry import ORACLES, query
from zephyria.catalog.source_queries import HOURLY_SQL
from zephyria.functions import classes
from zephyria.functions.numeric import guard
from zephyria.plans import daily, ingest, jobs
from zephyria.session import scratch_path
from zephyria.sources import feeds, warehouse
from zephyria.sources.tables import write_table

CLEAN_MET_SQL = q.with_(*q.CLEANED) + "select * from cm"
MERGED_SQL = q.with_(*q.MERGE_CHAIN) + "select * from merged"
FEATURES_SQL = q.with_(*q.FEATURE_CHAIN) + "select * from fe"


@query("clean_met", CLEAN_MET_SQL)
def clean_met(spark, sf):
    return daily.clean_weather(warehouse.met_daily(spark, sf))


@query("clean_aqi", q.with_(q.OBS, q.AQI, *q.CLEAN_AQI) + "select * from ca")
def clean_aqi(spark, sf):
    return daily.clean_air(warehouse.aqi_daily(spark, sf))


def merged(spark, sf):
    return daily.merge_daily(
        daily.clean_weather(warehouse.met_daily(spark, sf)), daily.clean_air(warehouse.aqi_daily(spark, sf))
    )


@query("merge_daily", MERGED_SQL)
def merge_daily(spark, sf):
    return merged(spark, sf)


@query("engineer_features", FEATURES_SQL)
def engineer_features(spark, sf):
    return daily.engineer_features(merged(spark, sf))


@query("preprocess_job", MERGED_SQL)
def preprocess_job(spark, sf):
    """Raw CSV tables to stored cleaned and merged tables."""
    return jobs.preprocess(spark, landing.raw_area(spark, sf)).drop("apparent_temp", "solar")


@query("features_job", FEATURES_SQL)
def features_job(spark, sf):
    root = landing.raw_area(spark, sf)
    jobs.preprocess(spark, root)
    return jobs.features(spark, root).drop("apparent_temp", "solar")


@query(
    "risk_job",
    q.with_(q.OBS, *q.scored("obs", "sc", "station_id, date")) + "select * from sc",
)
def risk_job(spark, sf):
    """Only raw tables exist, so weather is scored with the raw air table attached."""
    scored = jobs.risks(spark, landing.raw_area(spark, sf))
    risk_columns = [c for c in scored.columns if c.startswith("risk_")]
    return scored.select(*KEY, *risk_columns, "health_risk_score", "health_risk_label")


@query(
    "risk_job_no_air",
    q.with_(q.OBS, *q.scored("obs", "sc", "station_id, date", a="80e0", pm="40e0")) + "select * from sc",
)
def risk_job_no_air(spark, sf):
    """No air table exists anywhere, so the scores use the defaults of its columns."""
    root = scratch_path(spark, "project")
    write_table(landing.full_weather(spark, sf), jobs.raw(root, "meteorological"), fmt="csv")
    scored = jobs.risks(spark, root)
    risk_columns = [c for c in scored.columns if c.startswith("risk_")]
    return scored.select(*KEY, *risk_columns, "health_risk_score", "health_risk_label")


#: report -> the query with its SQL, its key columns, its value columns
_REPORTS = {
    "seasonal_stats": ("seasonal_stats", ("season", "variable"), ("mean", "std", "min", "max", "median")),
    "monthly_climatology": ("monthly_climatology", ("month",), config.MONTHLY_COLUMNS),
    "annual_trend": (
        "annual_trend",
        ("year",),
        (*config.TREND_COLUMNS, *[f"{c}_trend_slope" for c in config.TREND_COLUMNS]),
    ),
    "flood_risk_seasonal": ("flood_crosstab", ("season",), ("Low", "Medium", "High")),
    "aqi_seasonal_trend": ("aqi_month_trend", ("year", "month"), ("aqi",)),
    "dengue_risk_seasonal": ("dengue_crosstab", ("season",), ("Low", "Medium", "High")),
}


def _long_sql(report: str, name: str, keys, values) -> str:
    cells = ", ".join(f"{{'metric': '{v}', 'value': cast(\"{v}\" as double)}}" for v in values)
    key = ", ".join(f"cast({k} as varchar)" for k in keys)
    return f"""select '{report}' as report, concat_ws('/', {key}) as item, u.metric as metric, u.value as value
 from (select *, unnest([{cells}]) as u from ({ORACLES[name]}) r)"""


@query("seasonal_job", " union all ".join(_long_sql(r, *spec) for r, spec in _REPORTS.items()))
def seasonal_job(spark, sf):
    """All six reports of the job in long form, over a stored table that includes air quality."""
    root = scratch_path(spark, "project")
    risk = classes.dengue_risk(F.col("temperature_mean"), F.col("rainfall"), F.col("humidity"))
    labelled = lambda days: daily.label_weather(warehouse.add_calendar(days)).withColumn("dengue_risk", risk)
    write_table(obs(spark, sf).withColumn("year", F.year("date")), jobs.processed(root, "merged_dataset"), then=labelled)
    reports = jobs.seasonal(spark, root)
    out = None
    for report, (_, keys, values) in _REPORTS.items():
        cells = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
        item = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
        long = reports[report].select(F.lit(report).alias("report"), item.alias("item"), F.inline(cells))
        out = long if out is None else out.unionByName(long)
    return out


_FILLED_DAILY = """fd as (select station_id, date, temperature_max, temperature_min, temperature_mean, rainfall,
 coalesce(last_value(wind_speed ignore nulls) over (partition by station_id order by date rows between unbounded preceding and current row),
  first_value(wind_speed ignore nulls) over (partition by station_id order by date rows between current row and unbounded following)) as wind_speed,
 temperature_mean as apparent_temp from obs)"""


@query(
    "assemble_met",
    q.with_(
        q.OBS,
        _FILLED_DAILY,
        f"pr as (select station_id, date, humidity, {q.g('pressure/10e0*10e0')} as pressure, so2 as solar from obs)",
        *q.interpolated("pr", "fp", ("station_id", "date", "solar"), ("humidity", "pressure"), leading=False),
        f"""j as (select fd.*, coalesce({q.clip('humidity', 20, 100)}, 65e0) as humidity,
 coalesce({q.g(q.clip('pressure', 970, 1030))}, 1010e0) as pressure, solar from fd left join fp using (station_id, date))""",
        """a as (select * from j union all select station_id, cast(date + 3650 as date), temperature_max, temperature_min, temperature_mean,
 rainfall, wind_speed, null, 65e0, 1010e0, null from obs)""",
    )
    + f"select *, {q.CALENDAR} from a",
)
def assemble_met(spark, sf):
    """Both weather feeds from JSON, and ten years later a table without two columns."""
    extra = obs(spark, sf).select(
        "station_id",
        F.date_add("date", 3650).alias("date"),
        *[F.col(c) for c in ("temperature_max", "temperature_min", "temperature_mean", "rainfall", "wind_speed")],
        F.lit(65.0).alias("humidity"),
        F.lit(1010.0).alias("pressure"),
    )
    weather = ingest.assemble_weather(
        feeds.daily_feed(spark, landing.daily_feed(spark, sf)),
        feeds.parameter_feed(spark, landing.parameter_feed(spark, sf)),
        extra,
    )
    return weather.withColumn("pressure", guard(F.col("pressure")))


_OBSERVED = ("pm25", "pm10", "co", "no2", "aqi")


def _filled(c: str) -> str:
    part = "partition by station_id order by date rows between"
    return f"""coalesce(last_value({c} ignore nulls) over ({part} unbounded preceding and current row),
 first_value({c} ignore nulls) over ({part} current row and unbounded following))"""


@query(
    "assemble_aqi",
    q.with_(
        q.OBS,
        HOURLY_SQL,
        f"""dm as (select station_id, cast(ts as date) as date, {', '.join(f'{q.r(f"avg({c})", 6)} as {c}' for c in ('pm25', 'pm10', 'no2', 'aqi'))},
 {q.r('avg(case when co_raw <> 0 then co_raw/1000e0 end)', 6)} as co from hourly group by 1, 2)""",
        f"fl as (select station_id, date, {', '.join(f'{_filled(c)} as {c}' for c in _OBSERVED)} from dm)",
    )
    + f"""select station_id, date, {', '.join(_OBSERVED)} from obs where date < date '2022-01-01'
 union all select station_id, date, {', '.join(_OBSERVED)} from fl where date >= date '2022-01-01'""",
)
def assemble_aqi(spark, sf):
    """Hourly feed from 2022 on, the warehouse's daily table before."""
    history = obs(spark, sf).select(*KEY, *_OBSERVED)
    hourly = feeds.hourly_feed(spark, landing.hourly_feed(spark, sf))
    return ingest.assemble_air(hourly, history).select(*KEY, *_OBSERVED)


@query(
    "spatial_job",
    f"""select h.*, f.flood_risk, f.annual_rainfall from ({ORACLES['uhi_hotspots']}) h
 left join ({ORACLES['first_high_ward']}) f using (ward)""",
)
def spatial_job(spark, sf):
    """Hot spots and flood zones of the job, by ward; clusters have their own queries."""
    root = scratch_path(spark, "project")
    write_table(landing.full_wards(spark, sf), jobs.raw(root, "ward"), fmt="csv")
    zones = jobs.spatial_report(spark, root, "flood_zones").select("ward", "flood_risk", "annual_rainfall")
    return jobs.spatial_report(spark, root, "hotspots").join(zones, "ward", "left")
