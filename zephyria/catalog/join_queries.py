"""Joins of the daily tables and of statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyria.catalog import sqltext as q
from zephyria.catalog.column_queries import KEY, obs
from zephyria.catalog.registry import query
from zephyria.functions.numeric import rnd
from zephyria.operators import joins
from zephyria.sources import warehouse

_MET_ONLY = "station_id, date, temperature_mean, rainfall"
#: The joined side is moved by this many days, so that either side has days the other lacks.
_SHIFT = 7
_MOVED = f"moved as (select * replace (cast(date + {_SHIFT} as date) as date) from obs)"


def moved(days):
    return days.withColumn("date", F.date_add("date", _SHIFT))


@query(
    "join_met_left",
    q.with_(q.OBS, _MOVED)
    + """select station_id, date, o.temperature_mean, o.rainfall, coalesce(m.humidity, 65e0) as humidity,
 coalesce(m.pressure, 1010e0) as pressure, m.so2 as solar from obs o left join moved m using (station_id, date)""",
)
def join_met_left(spark, sf):
    """The radiation table starts a week later, so either side has days of its own."""
    days = obs(spark, sf)
    radiation = moved(days).select(*KEY, "humidity", "pressure", F.col("so2").alias("solar"))
    return joins.join_radiation(days.select(*_MET_ONLY.split(", ")), radiation)


_JOINED = f"""select m.*, a.aqi, a.pm25, a.pm10, a.humidity as humidity_aqi
 from (select {_MET_ONLY}, humidity, year, month, season from daily) m
 join (select station_id, date, aqi, pm25, pm10, o3 as humidity from moved) a using (station_id, date)"""


@query("join_met_aqi", q.with_(q.OBS, q.DAILY, _MOVED) + _JOINED)
def join_met_aqi(spark, sf):
    """Both sides carry a humidity column; the air side's is suffixed."""
    days = obs(spark, sf)
    weather = warehouse.add_calendar(days.select(*_MET_ONLY.split(", "), "humidity"), ("year", "month", "season"))
    air = warehouse.add_calendar(moved(days), ("year", "month", "season"))
    return joins.join_weather_air(
        weather, air.select(*joins.MERGE_KEYS, "aqi", "pm25", "pm10", F.col("o3").alias("humidity"))
    )


@query("join_on_demand", q.with_(q.OBS, q.DAILY, _MOVED) + _JOINED)
def join_on_demand(spark, sf):
    """The air table has neither year, month nor season: they are derived first."""
    days = obs(spark, sf)
    weather = warehouse.add_calendar(days.select(*_MET_ONLY.split(", "), "humidity"), ("year", "month", "season"))
    air = moved(days).select(*KEY, "aqi", "pm25", "pm10", F.col("o3").alias("humidity"))
    return joins.join_weather_air(weather, air)


@query(
    "join_aqi_left",
    q.with_(q.OBS, _MOVED)
    + "select station_id, date, o.temperature_mean, o.rainfall, m.aqi, m.pm25 from obs o left join moved m using (station_id, date)",
)
def join_aqi_left(spark, sf):
    days = obs(spark, sf)
    return joins.attach_air(days.select(*_MET_ONLY.split(", ")), moved(days))


@query(
    "join_stats",
    q.with_(q.OBS, f"s as (select station_id, {q.r('avg(aqi)', 6)} as station_mean, max(aqi) as station_max from obs group by 1)")
    + f"""select station_id, date, aqi, station_mean, station_max, (select min(aqi) from obs) as table_min,
 {q.r('(select avg(aqi) from obs)', 6)} as table_mean from obs join s using (station_id)""",
)
def join_stats(spark, sf):
    """Statistics per station by join, of the whole table by scalar subquery."""
    days = obs(spark, sf).select(*KEY, "aqi")
    keyed = joins.with_key_stats(
        days, {"station_mean": rnd(F.avg("aqi"), 6), "station_max": F.max("aqi")}, ["station_id"]
    )
    with_row = keyed.withColumn("stats", joins.table_row(days, {"lo": F.min("aqi"), "mean": F.avg("aqi")}))
    return with_row.select(
        *keyed.columns, F.col("stats.lo").alias("table_min"), rnd(F.col("stats.mean"), 6).alias("table_mean")
    )
