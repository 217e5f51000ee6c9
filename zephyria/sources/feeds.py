"""Landed JSON feeds to rows.

Feed documents hold a calendar period of one station each (parallel arrays, or
a date-keyed map per parameter); they are split into rows inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyria import config
from zephyria.functions.numeric import clip, no_nan, sentinel_to_null
from zephyria.sources import schemas


def _array_rows(df: DataFrame, block: str, fields: dict[str, str]) -> DataFrame:
    arrays = [F.col(f"{block}.{name}").alias(name) for name in ("time", *fields)]
    return df.select("station_id", F.inline(F.arrays_zip(*arrays)))


def _renamed(fields: dict[str, str]) -> list[Column]:
    return [no_nan(F.col(source)).alias(target) for source, target in fields.items()]


def daily_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row per station and day from ``daily.{time[], measure[]...}``."""
    raw = spark.read.schema(schemas.DAILY_FEED).json(path)
    rows = _array_rows(raw, "daily", schemas.DAILY_FEED_FIELDS)
    return rows.select("station_id", F.to_date("time").alias("date"), *_renamed(schemas.DAILY_FEED_FIELDS))


def hourly_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row per station and hour from ``hourly.{time[], pollutant[]...}``."""
    raw = spark.read.schema(schemas.HOURLY_FEED).json(path)
    rows = _array_rows(raw, "hourly", schemas.HOURLY_FEED_FIELDS)
    return rows.select("station_id", F.to_timestamp("time").alias("ts"), *_renamed(schemas.HOURLY_FEED_FIELDS))


def parameter_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row per station and day from ``parameter.{name}.{yyyymmdd: value}``.

    Every day that any of the parameters has is a row. Looking the maps up by day
    keeps this in the scan stage: no pivot shuffle.
    """
    raw = spark.read.schema(schemas.PARAMETER_FEED).json(path)
    names = list(schemas.PARAMETER_FEED_FIELDS)
    maps = raw.select("station_id", *[F.col("properties.parameter")[n].alias(n) for n in names])
    keys = [F.coalesce(F.map_keys(n), F.array().cast("array<string>")) for n in names]
    days = maps.select("station_id", F.explode(F.array_distinct(F.concat(*keys))).alias("day"), *names)
    return days.select(
        "station_id",
        F.to_date("day", "yyyyMMdd").alias("date"),
        *[no_nan(F.try_element_at(n, F.col("day"))).alias(c) for n, c in schemas.PARAMETER_FEED_FIELDS.items()],
    )


def clean_parameters(df: DataFrame) -> DataFrame:
    """Sentinel to NULL, then pressure from kPa to hPa."""
    out = {c: sentinel_to_null(F.col(c), config.MISSING_SENTINEL) for c in schemas.PARAMETER_FEED_FIELDS.values()}
    out["pressure"] = out["pressure"] * 10.0
    return df.withColumns(out)


def co_to_mg(co: Column) -> Column:
    """ug to mg per cubic metre; a reading of exactly zero means "no reading"."""
    return F.when(co != 0, co / 1000.0)


def clip_feed_ranges(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "humidity": clip(F.col("humidity"), *config.HUMIDITY_RANGE),
            "pressure": clip(F.col("pressure"), *config.PRESSURE_RANGE),
        }
    )
