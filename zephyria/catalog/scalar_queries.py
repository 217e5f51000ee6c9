"""Indicators, health scores, colours and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyria import config
from zephyria.catalog import sqltext as q
from zephyria.catalog.column_queries import KEY, obs
from zephyria.catalog.registry import query
from zephyria.functions import classes, health, indicators
from zephyria.functions.calendar import season_flag_name
from zephyria.functions.numeric import clip, rnd
from zephyria.functions.text import display_name, fixed
from zephyria.operators import spatial
from zephyria.operators.aggregates import mean_of
from zephyria.operators.columns import add_calendar
from zephyria.operators.windows import flatten_steps, sequences
from zephyria.plans.daily import score_health
from zephyria.sources import warehouse


def _per_day(expr: str, name: str) -> str:
    return q.with_(q.OBS) + f"select station_id, date, {expr} as {name} from obs"


def _register(name: str, expr: str, column, out: str | None = None) -> None:
    """One scalar column over the whole daily table."""
    out = out or name

    @query(name, _per_day(expr, out))
    def run(spark, sf):
        return obs(spark, sf).select(*KEY, column().alias(out))


def _c(*names: str):
    return [F.col(n) for n in names]


_register("heat_index", q.heat_index("temperature_mean", "humidity"), lambda: indicators.heat_index(*_c("temperature_mean", "humidity")))
_register("discomfort_index", q.discomfort("temperature_mean", "humidity"), lambda: indicators.discomfort_index(*_c("temperature_mean", "humidity")))
_register("uhi_score", q.uhi("temperature_mean"), lambda: indicators.uhi_score(F.col("temperature_mean")))
_register("pollution_severity", q.pollution("pm25", "aqi"), lambda: indicators.pollution_severity(*_c("pm25", "aqi")))

_RISK = q.risk_scores()
_register("heat_exhaustion_risk", _RISK["heat_exhaustion"], lambda: health.heat_exhaustion(*_c("temperature_mean", "humidity")))
_register("dehydration_risk", _RISK["dehydration"], lambda: health.dehydration(*_c("temperature_mean", "humidity", "wind_speed")))
_register("respiratory_risk", _RISK["respiratory"], lambda: health.respiratory(*_c("aqi", "pm25")))
_register("flood_health_risk", _RISK["flood_health"], lambda: health.flood_health(*_c("rainfall", "humidity")))
_register("dengue_vector_risk", _RISK["dengue_vector"], lambda: health.dengue_vector(*_c("temperature_mean", "rainfall", "humidity")))
_register("sleep_disturbance_risk", _RISK["sleep_disturb"], lambda: health.sleep_disturb(*_c("temperature_min", "humidity")))
_register("productivity_reduction", _RISK["productivity"], lambda: health.productivity(*_c("temperature_mean", "aqi")))


@query(
    "overall_health_risk_score",
    q.with_(q.OBS, *q.scored("obs", "sc", "station_id, date")) + "select station_id, date, health_risk_score from sc",
)
def overall_health_risk_score(spark, sf):
    return score_health(obs(spark, sf)).select(*KEY, "health_risk_score")


_HEALTH_KEEP = "station_id, date, temperature_mean, temperature_min, humidity, wind_speed, rainfall, aqi, pm25"


@query("health_risks", q.with_(q.OBS, *q.scored("obs", "sc", _HEALTH_KEEP)) + "select * from sc")
def health_risks(spark, sf):
    """The flagship: seven scores, composite and label for every station-day."""
    return score_health(obs(spark, sf).select(*_HEALTH_KEEP.split(", ")))


@query(
    "vegetation_loss_score",
    q.with_(q.WARD) + f"select year, ward, ndvi, {q.r(q.clip('0.55e0-ndvi', 0, 1), 3)} as vegetation_loss_score from ward",
)
def vegetation_loss_score(spark, sf):
    return warehouse.ward_year(spark, sf).select(
        "year", "ward", "ndvi", indicators.vegetation_loss(F.col("ndvi")).alias("vegetation_loss_score")
    )


@query(
    "water_body_shrinkage",
    q.with_(q.LAND)
    + f"""select region_id, year, ndvi, water_pct, {q.r(q.clip('0.55e0-ndvi', 0, 1), 3)} as vegetation_loss_score,
 {q.r(q.clip('((select max(water_pct) from land)-water_pct)/((select max(water_pct) from land)+1e-9)', 0, 1), 3)} as water_body_shrinkage
 from land""",
)
def water_body_shrinkage(spark, sf):
    return spatial.land_scores(warehouse.landuse_year(spark, sf))


_RATIO = "((avg_temp-(select min(avg_temp) from wm))/((select max(avg_temp) from wm)-(select min(avg_temp) from wm)+1e-9))"


@query(
    "value_color",
    q.with_(
        q.WARD,
        f"wm as (select ward, {q.r('avg(avg_temp)', 6)} as avg_temp, {q.r('avg(lat)', 6)} as lat, {q.r('avg(lon)', 6)} as lon from ward group by ward)",
    )
    + f"""select ward, avg_temp, lat, lon, printf('#%02x40%02x', cast(trunc({q.g(_RATIO + '*255e0')}) as integer),
 cast(trunc({q.g('(1e0-' + _RATIO + ')*255e0')}) as integer)) as colour from wm""",
)
def value_color(spark, sf):
    return spatial.ward_colours(warehouse.ward_year(spark, sf), "avg_temp")


# --- scalar functions -----------------------------------------------------------
_NAMED = ("temperature_mean", "wind_speed", "pm25")


@query(
    "str_display_name",
    q.with_(q.OBS, q.DAILY, f"u as (unpivot (select season, {', '.join(_NAMED)} from daily) on {', '.join(_NAMED)} into name variable value value)")
    + f"""select season, variable, case variable when 'temperature_mean' then 'Temperature Mean' when 'wind_speed' then 'Wind Speed' else 'Pm25' end as label,
 'season_' || replace(season, ' ', '_') as flag_name, replace(variable, '_mean', '') as short_name, {q.r('avg(value)', 6)} as mean_value from u group by season, variable""",
)
def str_display_name(spark, sf):
    """Display names of unpivoted measures, with each season's mean."""
    wide = add_calendar(obs(spark, sf), ("season",)).groupBy("season").agg(*[rnd(F.avg(c), 6).alias(c) for c in _NAMED])
    long = wide.unpivot(["season"], list(_NAMED), "variable", "mean_value")
    names = F.create_map(*[F.lit(x) for s in config.SEASON_MONTHS for x in (s, season_flag_name(s))])
    return long.select(
        "season",
        "variable",
        display_name(F.col("variable")).alias("label"),
        names[F.col("season")].alias("flag_name"),
        F.replace("variable", F.lit("_mean"), F.lit("")).alias("short_name"),
        "mean_value",
    )


@query(
    "str_format",
    q.with_(q.OBS)
    + f"""select station_id, printf('%.1f C', {q.r('avg(temperature_mean)', 1)}) as mean_temp, printf('%.0f mm', {q.r('sum(rainfall)', 0)}) as rain,
 printf('%.3f', {q.r('avg(co)', 3)}) as co, printf('%.1f%%', {q.r('avg(humidity)', 1)}) as humidity from obs group by station_id""",
)
def str_format(spark, sf):
    return obs(spark, sf).groupBy("station_id").agg(
        fixed(mean_of("temperature_mean", 1), 1, " C").alias("mean_temp"),
        fixed(rnd(F.sum("rainfall"), 0), 0, " mm").alias("rain"),
        fixed(mean_of("co", 3), 3).alias("co"),
        fixed(mean_of("humidity", 1), 1, "%").alias("humidity"),
    )


@query(
    "date_scalars",
    """select event_id, cast(ts as date) as date, cast(year(ts) as integer) as year, cast(month(ts) as integer) as month,
 cast(day(ts) as integer) as day, cast(dayofyear(ts) as integer) as doy,
 cast(strptime(strftime(ts, '%Y%m%d'), '%Y%m%d') as date) as parsed from events""",
)
def date_scalars(spark, sf):
    events = warehouse.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("date"))
    dated = add_calendar(events, ("year", "month", "day", "doy"))
    return dated.withColumn("parsed", F.to_date(F.date_format("date", "yyyyMMdd"), "yyyyMMdd"))


@query(
    "map_lookup",
    q.with_(q.WARD)
    + f"""select year, ward, flood_risk, {q.coded('flood_risk', ('Low', 'Medium'), 9)} as code from ward""",
)
def map_lookup(spark, sf):
    """A label absent from the dictionary takes the default."""
    wards = warehouse.ward_year(spark, sf).select("year", "ward", "flood_risk")
    return wards.withColumn("code", classes.code_of(F.col("flood_risk"), {"Low": 0, "Medium": 1}, 9))


@query(
    "math_scalars",
    q.with_(q.OBS)
    + f"""select station_id, date, {q.r('exp(-temperature_mean/50e0)', 6)} as decay, {q.r('humidity*humidity', 6)} as squared,
 {q.r('abs(temperature_mean-30e0)', 6)} as distance, {q.clip('rainfall', 5, 50)} as clipped,
 case when temperature_mean>27 then aqi else pm25 end as chosen, {q.r('sqrt(aqi)', 6)} as root, {q.r('pressure', 1)} as rounded from obs""",
)
def math_scalars(spark, sf):
    t = F.col("temperature_mean")
    return obs(spark, sf).select(
        *KEY,
        rnd(F.exp(-t / 50.0), 6).alias("decay"),
        rnd(F.pow("humidity", F.lit(2.0)), 6).alias("squared"),
        rnd(F.abs(t - 30.0), 6).alias("distance"),
        clip(F.col("rainfall"), 5, 50).alias("clipped"),
        F.when(t > 27, F.col("aqi")).otherwise(F.col("pm25")).alias("chosen"),
        rnd(F.sqrt("aqi"), 6).alias("root"),
        rnd(F.col("pressure"), 1).alias("rounded"),
    )


_SEQ = ("temperature_mean", "humidity", "pressure", "wind_speed")


@query(
    "array_flatten",
    q.with_(
        q.OBS,
        f"rws as (select * from obs where {' and '.join(f'{c} is not null' for c in _SEQ)})",
        "sq as (select station_id, date, "
        + ", ".join(
            f"array_agg({c}) over (partition by station_id order by date rows between 30 preceding and 1 preceding) as {c}_l"
            for c in _SEQ
        )
        + " from rws)",
    )
    + f"""select station_id, date, cast(120 as integer) as n_values, temperature_mean_l[1] as first_value,
 temperature_mean_l[2] as fifth_value, wind_speed_l[30] as last_value,
 {q.r('+'.join(f'list_sum({c}_l)' for c in _SEQ), 4)} as total from sq where len(temperature_mean_l) = 30""",
)
def array_flatten(spark, sf):
    """Each 30 x 4 window as one vector of 120 values, summarised."""
    windows = sequences(obs(spark, sf), _SEQ, "temperature_mean")
    flat = windows.select(*KEY, flatten_steps(F.col("steps"), _SEQ).alias("v"))
    return flat.select(
        *KEY,
        F.size("v").alias("n_values"),
        F.col("v")[0].alias("first_value"),
        F.col("v")[4].alias("fifth_value"),
        F.col("v")[119].alias("last_value"),
        rnd(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
    )


@query(
    "json_scalars",
    """select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, 'k' as key,
 json_extract_string(props, '$.k') as value, cast(2 as integer) as n_zipped from events""",
)
def json_scalars(spark, sf):
    """Nested access, map explosion and array zip on the JSON property column."""
    events = warehouse.table(spark, sf, "events").select(
        "event_id",
        F.from_json("props", "struct<k: bigint>").alias("obj"),
        F.from_json("props", "map<string,string>").alias("kv"),
    )
    exploded = events.select("event_id", F.col("obj").getField("k").alias("k"), F.explode("kv").alias("key", "value"))
    zipped = F.arrays_zip(F.array("k", F.lit(0).cast("bigint")), F.array("value", F.lit("0")))
    return exploded.withColumn("n_zipped", F.size(zipped))


@query(
    "membership",
    q.with_(q.OBS, q.DAILY)
    + "select station_id, date, month, month in (6,7,8,9) as is_monsoon, month in (12,1,2) as is_winter from daily",
)
def membership(spark, sf):
    days = add_calendar(obs(spark, sf).select(*KEY), ("month",))
    month = F.col("month")
    return days.select(
        *KEY,
        "month",
        month.isin(*config.SEASON_MONTHS["Southwest Monsoon"]).alias("is_monsoon"),
        month.isin(*config.SEASON_MONTHS["Winter"]).alias("is_winter"),
    )
