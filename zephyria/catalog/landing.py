"""Files landed from the warehouse tables, for the queries that read files.

Everything goes below the cluster's shared folder. Each feed document covers a
calendar period of one station (a year of days, or one day of hours), so its
arrays have at most 366 or 24 entries however busy the station is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyria.session import scratch_path
from zephyria.sources import schemas, warehouse
from zephyria.sources.tables import write_table

HOURLY_SOURCE = {"click": "pm25", "view": "pm10", "purchase": "co", "signup": "no2", "error": "aqi"}


def full_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather table with every stored column."""
    obs = warehouse.add_calendar(warehouse.obs_daily(spark, sf_dir))
    return obs.withColumns({"apparent_temp": F.col("temperature_mean"), "solar": F.col("so2")}).select(
        *schemas.WEATHER.fieldNames()
    )


def full_air(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.aqi_daily(spark, sf_dir).select(*schemas.AIR.fieldNames())


def full_wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    wards = warehouse.ward_year(spark, sf_dir)
    return wards.withColumns(
        {
            "population_den": F.lit(None).cast("double"),
            "health_risk": F.lit(None).cast("string"),
            "dengue_risk": F.lit(None).cast("string"),
        }
    ).select(*schemas.WARD.fieldNames())


def land_csv(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    write_table(df, path, fmt="csv")
    return path


def raw_area(spark: SparkSession, sf_dir: str) -> str:
    """A project root holding the raw weather, air and ward tables."""
    root = scratch_path(spark, "project")
    write_table(full_weather(spark, sf_dir), f"{root}/raw/meteorological", fmt="csv")
    write_table(full_air(spark, sf_dir), f"{root}/raw/aqi", fmt="csv")
    write_table(full_wards(spark, sf_dir), f"{root}/raw/ward", fmt="csv")
    return root


def _series(item: Column) -> Column:
    """The group's items ordered by their first field."""
    return F.array_sort(F.collect_list(item))


def _array_of(entries: str, field: str) -> Column:
    return F.transform(entries, lambda e: e[field]).alias(field)


def _arrays(entries: str, fields: list[str]) -> list[Column]:
    return [_array_of(entries, n) for n in fields]


def daily_feed(spark: SparkSession, sf_dir: str) -> str:
    """One document per station and year."""
    obs = full_weather(spark, sf_dir)
    item = F.struct(
        F.col("date").cast("string").alias("time"),
        *[F.col(column).alias(field) for field, column in schemas.DAILY_FEED_FIELDS.items()],
    )
    docs = obs.groupBy("station_id", "year").agg(_series(item).alias("e"))
    fields = ["time", *schemas.DAILY_FEED_FIELDS]
    path = scratch_path(spark, "daily-feed")
    docs.select("station_id", F.struct(*_arrays("e", fields)).alias("daily")).write.json(path)
    return path


def parameter_feed(spark: SparkSession, sf_dir: str) -> str:
    """One document per station and year; missing humidity is written as -999."""
    obs = full_weather(spark, sf_dir)
    value = {"RH2M": F.coalesce("humidity", F.lit(-999.0)), "PS": F.col("pressure") / 10.0, "ALLSKY_SFC_SW_DWN": F.col("solar")}
    day = F.date_format("date", "yyyyMMdd").alias("day")
    maps = {
        n: F.map_from_entries(F.collect_list(F.struct(day, v.alias("v")))).alias(n) for n, v in value.items()
    }
    docs = obs.groupBy("station_id", "year").agg(*maps.values())
    parameter = F.create_map(*[x for n in maps for x in (F.lit(n), F.col(n))]).alias("parameter")
    path = scratch_path(spark, "parameter-feed")
    docs.select("station_id", F.struct(parameter).alias("properties")).write.json(path)
    return path


def hourly_feed(spark: SparkSession, sf_dir: str) -> str:
    """One document per station and day from the readings, averaged per hour."""
    readings = warehouse.feed_hourly(spark, sf_dir)
    kind = F.col("pollutant")
    hourly = readings.groupBy("station_id", F.date_trunc("hour", "ts").alias("hour")).agg(
        *[F.avg(F.when(kind == k, F.col("value"))).alias(c) for k, c in HOURLY_SOURCE.items()]
    )
    columns = set(HOURLY_SOURCE.values())
    item = F.struct(
        F.date_format("hour", "yyyy-MM-dd'T'HH:mm").alias("time"),
        *[
            (F.col(c) if c in columns else F.lit(None).cast("double")).alias(field)
            for field, c in schemas.HOURLY_FEED_FIELDS.items()
        ],
    )
    docs = hourly.groupBy("station_id", F.to_date("hour").alias("day")).agg(_series(item).alias("e"))
    fields = ["time", *schemas.HOURLY_FEED_FIELDS]
    path = scratch_path(spark, "hourly-feed")
    docs.select("station_id", F.struct(*_arrays("e", fields)).alias("hourly")).write.json(path)
    return path
