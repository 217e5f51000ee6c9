"""Projections, predicates, cleaning and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyria.catalog.registry import query
from zephyria.catalog.sqltext import (
    CALENDAR,
    DAILY,
    MET,
    OBS,
    SEASONS,
    WARD,
    WEATHER,
    blanked,
    clip,
    coded,
    g,
    interpolated,
    r,
    scored,
    with_,
)
from zephyria.functions.calendar import month_name
from zephyria.functions.numeric import clip as clip_column
from zephyria.functions.numeric import guard, rnd, sentinel_to_null
from zephyria.operators import columns, gaps, scaling
from zephyria.operators.aggregates import means
from zephyria.operators.spatial import high_flood_rows
from zephyria.plans.clustering import ward_profiles
from zephyria.plans.daily import score_health
from zephyria.sources import warehouse
from zephyria.sources.feeds import co_to_mg

KEY = ("station_id", "date")


def obs(spark, sf):
    return warehouse.obs_daily(spark, sf)


@query("date_parts", with_(OBS) + f"select station_id, date, {CALENDAR.split(', case')[0]} from obs")
def date_parts(spark, sf):
    return columns.add_calendar(obs(spark, sf).select(*KEY), ("year", "month", "day", "doy"))


@query("season_of", with_(OBS, DAILY) + "select station_id, date, month, season from daily")
def season_of(spark, sf):
    return columns.add_calendar(obs(spark, sf).select(*KEY), ("month", "season"))


_FLAGS = ", ".join(
    f"""cast(case when season='{s}' then 1 else 0 end as integer) as "season_{s.replace(' ', '_')}\"""" for s in SEASONS
)


@query("season_onehot", with_(OBS, DAILY) + f"select station_id, date, season, {_FLAGS} from daily")
def season_onehot(spark, sf):
    return columns.add_season_flags(columns.add_calendar(obs(spark, sf).select(*KEY), ("season",)))


@query("sentinel_null", with_(OBS) + "select station_id, date, humidity, wind_speed from obs")
def sentinel_null(spark, sf):
    """Missing readings are first written as the sentinel, as the feed does."""
    coded_missing = obs(spark, sf).select(*KEY, *[F.coalesce(c, F.lit(-999.0)).alias(c) for c in ("humidity", "wind_speed")])
    return coded_missing.withColumns({c: sentinel_to_null(F.col(c), -999.0) for c in ("humidity", "wind_speed")})


@query(
    "unit_convert",
    with_(OBS)
    + f"""select station_id, date, {g('pressure*10e0')} as pressure, {g('case when o3<>0 then o3/1000e0 end')} as co from obs""",
)
def unit_convert(spark, sf):
    """o3 stands for the raw gas column because it contains zeros."""
    return obs(spark, sf).select(
        *KEY, guard(F.col("pressure") * 10.0).alias("pressure"), guard(co_to_mg(F.col("o3"))).alias("co")
    )


@query(
    "clip_range",
    with_(OBS)
    + f"""select station_id, date, {clip('humidity', 20, 100)} as humidity, {clip('pressure', 980, 1020)} as pressure,
 {clip('wind_speed', lo=10)} as wind_speed from obs""",
)
def clip_range(spark, sf):
    return obs(spark, sf).select(
        *KEY,
        clip_column(F.col("humidity"), 20, 100).alias("humidity"),
        clip_column(F.col("pressure"), 980, 1020).alias("pressure"),
        clip_column(F.col("wind_speed"), lo=10).alias("wind_speed"),
    )


@query(
    "fill_const",
    with_(OBS)
    + "select station_id, date, coalesce(humidity, 65e0) as humidity, coalesce(pressure, 1010e0) as pressure from obs",
)
def fill_const(spark, sf):
    return columns.fill_constants(obs(spark, sf).select(*KEY, "humidity", "pressure"))


@query("parse_date", with_(OBS) + "select station_id, date as iso_date, date as compact_date from obs")
def parse_date(spark, sf):
    text = obs(spark, sf).select(
        "station_id", F.col("date").cast("string").alias("iso"), F.date_format("date", "yyyyMMdd").alias("compact")
    )
    return text.select(
        "station_id", F.to_date("iso").alias("iso_date"), F.to_date("compact", "yyyyMMdd").alias("compact_date")
    )


@query(
    "year_range",
    with_(OBS, DAILY) + "select station_id, date, year, aqi from daily where year between 1997 and 1999",
)
def year_range(spark, sf):
    daily = columns.add_calendar(obs(spark, sf), ("year",)).select(*KEY, "year", "aqi")
    return columns.year_range(daily, 1997, 1999)


@query(
    "cutover_split",
    with_(OBS)
    + """select station_id, date, aqi, case when date < date '1999-01-01' then 'history' else 'observed' end as side from obs""",
)
def cutover_split(spark, sf):
    before, after = columns.split_at(obs(spark, sf).select(*KEY, "aqi"), "1999-01-01")
    return before.withColumn("side", F.lit("history")).unionByName(after.withColumn("side", F.lit("observed")))


@query("year_cap", with_(OBS, DAILY) + "select station_id, date, year, temperature_mean from daily where year <= 1998")
def year_cap(spark, sf):
    daily = columns.add_calendar(obs(spark, sf).select(*KEY, "temperature_mean"), ("year",))
    return columns.year_cap(daily, 1998)


@query("select_existing", with_(OBS) + "select station_id, date, temperature_mean, humidity, aqi from obs")
def select_existing(spark, sf):
    wanted = ("temperature_mean", "ndvi", "humidity", "dew_point", "aqi")
    return columns.select_existing(obs(spark, sf), wanted, keep=KEY)


@query(
    "select_prefix",
    with_(OBS, *scored("obs", "sc", "station_id, date"))
    + "select station_id, date, columns('^risk_.*') from sc",
)
def select_prefix(spark, sf):
    scored_days = score_health(obs(spark, sf))
    return scored_days.select(*KEY, *columns.with_prefix(scored_days, "risk_"))


@query(
    "dropna_subset",
    with_(OBS)
    + """select station_id, date, humidity, wind_speed, aqi from obs where humidity is not null and wind_speed is not null""",
)
def dropna_subset(spark, sf):
    return columns.drop_missing(obs(spark, sf).select(*KEY, "humidity", "wind_speed", "aqi"), ["humidity", "wind_speed"])


@query(
    "absent_defaults",
    with_(OBS, *scored("obs", "sc", "station_id, date, temperature_mean, humidity", tmin="(temperature_mean-4e0)", wind="12e0", rain="3e0", a="80e0", pm="40e0"))
    + "select * from sc",
)
def absent_defaults(spark, sf):
    """Only temperature and humidity columns exist; the rest are constants."""
    return score_health(obs(spark, sf).select(*KEY, "temperature_mean", "humidity"))


@query(
    "absent_features",
    with_(OBS, DAILY)
    + f"""select station_id, date, season, temperature_mean, humidity, aqi, rainfall,
 {coded('season', SEASONS, 0)} as season_code, {g(clip('temperature_mean-26.5e0', 0))} as uhi_score,
 temperature_mean as heat_index, {g('temperature_mean-0.55e0*(1e0-humidity/100e0)*(temperature_mean-14.5e0)')} as discomfort_index,
 {g(clip('aqi/500e0', 0, 1))} as pollution_severity, 0e0 as rainfall_anomaly,
 cast(case flood_risk when 'High' then 0 when 'Low' then 1 when 'Medium' then 2 end as integer) as flood_risk_ordinal,
 cast(0 as integer) as aqi_ordinal, cast(0 as integer) as temp_class_ordinal, cast(0 as integer) as rain_class_ordinal,
 cast(0 as integer) as health_risk_ordinal, cast(0 as integer) as dengue_risk_ordinal
 from (select *, case when rainfall<10 then 'Low' when rainfall<40 then 'Medium' when rainfall<70 then 'High' else 'Low' end as flood_risk from daily) q""",
)
def absent_features(spark, sf):
    """A merged table without engineered features; one label column has gaps."""
    daily = columns.add_calendar(obs(spark, sf), ("season",))
    rain = F.col("rainfall")
    label = F.when(rain < 10, "Low").when(rain < 40, "Medium").when(rain < 70, "High")
    base = daily.select(*KEY, "season", "temperature_mean", "humidity", "aqi", "rainfall", label.alias("flood_risk"))
    filled = columns.fill_absent_features(base).drop("flood_risk")
    rounded = ("uhi_score", "discomfort_index", "pollution_severity")
    return filled.withColumns({c: guard(F.col(c)) for c in rounded})


def _nearest(c: str) -> str:
    return f"""coalesce(last_value({c} ignore nulls) over (partition by station_id order by date rows between unbounded preceding and current row),
 first_value({c} ignore nulls) over (partition by station_id order by date rows between current row and unbounded following)) as {c}"""


@query(
    "ffill_bfill",
    with_(OBS) + f"select station_id, date, {_nearest('humidity')}, {_nearest('wind_speed')} from obs",
)
def ffill_bfill(spark, sf):
    return gaps.fill_nearest(obs(spark, sf).select(*KEY, "humidity", "wind_speed"))


@query(
    "interp_both",
    with_(OBS, *interpolated("obs", "f", KEY, ("humidity", "wind_speed"))) + "select * from f",
)
def interp_both(spark, sf):
    return gaps.interpolate(obs(spark, sf).select(*KEY, "humidity", "wind_speed"))


@query(
    "interp_fwd",
    with_(OBS, *interpolated("obs", "f", KEY, ("humidity", "wind_speed"), leading=False))
    + f"select station_id, date, {clip('humidity', 20, 100)} as humidity, wind_speed from f",
)
def interp_fwd(spark, sf):
    filled = gaps.interpolate(obs(spark, sf).select(*KEY, "humidity", "wind_speed"), leading=False)
    return filled.withColumn("humidity", clip_column(F.col("humidity"), 20, 100))


@query(
    "outlier_blank",
    with_(
        OBS,
        MET,
        *interpolated("met", "f", KEY, WEATHER),
        blanked("f", "b", KEY, WEATHER),
        *interpolated("b", "c", KEY, WEATHER),
    )
    + "select * from c",
)
def outlier_blank(spark, sf):
    return gaps.clean_series(obs(spark, sf).select(*KEY, *WEATHER), WEATHER)


@query(
    "minmax_scale",
    with_(OBS)
    + f"""select station_id, date, {r('(aqi-(select min(aqi) from obs))/(select max(aqi)-min(aqi) from obs)', 9)} as aqi,
 {r('(humidity-(select min(humidity) from obs))/(select max(humidity)-min(humidity) from obs)', 9)} as humidity from obs""",
)
def minmax_scale(spark, sf):
    scaled = scaling.normalise(obs(spark, sf).select(*KEY, "aqi", "humidity"), ["aqi", "humidity"])
    return scaled.withColumns({c: guard(F.col(c)) for c in ("aqi", "humidity")})


@query(
    "standard_scale",
    with_(OBS)
    + f"""select station_id, date, {r('(aqi-(select avg(aqi) from obs))/(select stddev_pop(aqi) from obs)', 6)} as aqi,
 {r('(humidity-(select avg(humidity) from obs))/(select stddev_pop(humidity) from obs)', 6)} as humidity from obs""",
)
def standard_scale(spark, sf):
    scaled = scaling.normalise(obs(spark, sf).select(*KEY, "aqi", "humidity"), ["aqi", "humidity"], "standard")
    return scaled.withColumns({c: rnd(F.col(c), 6) for c in ("aqi", "humidity")})


_WARD_MEANS = ", ".join(f"coalesce({r(f'avg({c})', 6)}, 0e0) as {c}" for c in ("avg_temp", "annual_rainfall", "avg_aqi", "ndvi", "buildup_pct"))


@query(
    "fillna_zero",
    with_(WARD, "gap as (select * replace (case when lat < 12.35e0 then avg_temp end as avg_temp) from ward)")
    + f"select ward, {_WARD_MEANS} from gap group by ward",
)
def fillna_zero(spark, sf):
    """The northernmost wards report no temperature at all."""
    wards = warehouse.ward_year(spark, sf)
    return ward_profiles(wards.withColumn("avg_temp", F.when(F.col("lat") < 12.35, F.col("avg_temp"))))


@query(
    "lookup_label",
    with_(OBS, DAILY)
    + f"""select month, case month when 1 then 'Jan' when 2 then 'Feb' when 3 then 'Mar' when 4 then 'Apr' when 5 then 'May'
 when 6 then 'Jun' when 7 then 'Jul' when 8 then 'Aug' when 9 then 'Sep' when 10 then 'Oct' when 11 then 'Nov' else 'Dec' end as month_name,
 {r('avg(rainfall)', 6)} as rainfall from daily group by month""",
)
def lookup_label(spark, sf):
    by_month = means(columns.add_calendar(obs(spark, sf), ("month",)), ["rainfall"], ["month"], 6)
    return by_month.withColumn("month_name", month_name(F.col("month")))


@query("flood_high_rows", with_(WARD) + "select year, ward, lat, lon, avg_temp, annual_rainfall, flood_risk from ward where flood_risk='High'")
def flood_high_rows(spark, sf):
    return high_flood_rows(warehouse.ward_year(spark, sf))


@query(
    "inverse_scale",
    with_(OBS) + f"select station_id, date, {r('aqi', 6)} as aqi, {r('rainfall', 6)} as rainfall from obs",
)
def inverse_scale(spark, sf):
    """Scaled and brought back: the original values return."""
    days = obs(spark, sf).select(*KEY, "aqi", "rainfall")
    bounds = scaling.ranges(days, ["aqi", "rainfall"])
    scaled = scaling.minmax(days, ["aqi", "rainfall"], bounds)
    for c in ("aqi", "rainfall"):
        scaled = scaling.inverse_minmax(scaled, c, c, bounds)
    return scaled.withColumns({c: rnd(F.col(c), 6) for c in ("aqi", "rainfall")})
