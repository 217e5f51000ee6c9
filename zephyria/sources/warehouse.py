"""Climate tables derived from a generic order/event warehouse.

Deterministic column expressions turn the star-schema tables into the daily,
ward-year, land-use and feed tables the operators work on. Every measure is
rounded to the resolution of its table here, so that the order in which tasks
add floats can never reach a class threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyria.functions.numeric import rnd
from zephyria.operators.columns import add_calendar

WEATHER_MEASURES = (
    "temperature_mean",
    "temperature_max",
    "temperature_min",
    "humidity",
    "rainfall",
    "wind_speed",
    "pressure",
)
DAILY_DIGITS = 4  # readings come with limited resolution
YEARLY_DIGITS = 6
AIR_MEASURES = ("aqi", "pm25", "pm10", "no2", "so2", "co", "o3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _measures() -> dict[str, Column]:
    qty, price = F.col("l_quantity"), F.col("l_extendedprice")
    line, disc, order = F.col("l_linenumber"), F.col("l_discount"), F.col("l_orderkey")
    tax_pct = F.rint(F.col("l_tax") * 100.0)
    base = qty * 0.7 + 10.0
    return {
        "temperature_mean": F.avg(F.when(order % 997 == 0, 200.0).otherwise(base)),
        "temperature_max": F.max(base + 1.0 + line * 0.5),
        "temperature_min": F.min(base - 1.0 - line * 0.5),
        "humidity": F.avg(F.when(order % 17 != 0, disc * 1000.0)),
        "rainfall": F.avg(tax_pct * tax_pct * 1.25),
        "wind_speed": F.avg(F.when(order % 23 != 0, line * 5.0)),
        "pressure": F.avg(disc * 600.0 + 970.0),
        "aqi": F.avg(price / 250.0),
        "pm25": F.avg(price / 400.0),
        "pm10": F.avg(price / 250.0 + line),
        "no2": F.avg(qty * 2.0),
        "so2": F.avg(qty * 0.5),
        "co": F.avg(line * 0.4),
        "o3": F.avg(disc * 1500.0),
    }


def obs_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather and air per (station_id, date); that pair is unique.

    Grouping by station and day pre-aggregates on the map side and spreads one
    busy station over as many tasks as it has days.
    """
    lines = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_suppkey").alias("station_id"), F.col("l_shipdate").cast("date").alias("date")]
    return lines.groupBy(*keys).agg(*[rnd(c, DAILY_DIGITS).alias(n) for n, c in _measures().items()])


def met_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_calendar(obs_daily(spark, sf_dir).select("station_id", "date", *WEATHER_MEASURES))


def aqi_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs_daily(spark, sf_dir).select("station_id", "date", *AIR_MEASURES)


def ward_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators per (ward, year): nations stand for wards.

    Lines are first summed per supplier and year, so the joins to supplier and
    nation see one row per supplier-year instead of every line.
    """
    tax_pct = F.col("l_tax") * 100.0
    per_supplier = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("l_quantity") * 0.7 + 10.0).alias("temp"),
            F.sum(F.col("l_extendedprice") / 250.0).alias("aqi"),
            F.sum(tax_pct).alias("rain"),
            F.sum(F.col("l_discount") * 5.0).alias("ndvi"),
            F.sum(F.col("l_linenumber") * 10.0).alias("built"),
        )
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = per_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    n = F.sum("n")
    rain = rnd(F.sum("rain") / n, YEARLY_DIGITS)
    return (
        joined.groupBy("year", F.col("n_name").alias("ward"), "n_nationkey")
        .agg(
            rnd(F.sum("temp") / n, YEARLY_DIGITS).alias("avg_temp"),
            rnd(F.sum("rain"), YEARLY_DIGITS).alias("annual_rainfall"),
            rnd(F.sum("aqi") / n, YEARLY_DIGITS).alias("avg_aqi"),
            rnd(F.sum("ndvi") / n, YEARLY_DIGITS).alias("ndvi"),
            rnd(F.sum("built") / n, YEARLY_DIGITS).alias("buildup_pct"),
            F.when(rain < 3.95, "Low").when(rain < 4.05, "Medium").otherwise("High").alias("flood_risk"),
        )
        .withColumn("lat", rnd((F.col("n_nationkey") % 5) * 0.1 + 12.0, YEARLY_DIGITS))
        .withColumn("lon", rnd(F.floor(F.col("n_nationkey") / 5) * 0.1 + 77.0, YEARLY_DIGITS))
        .select("year", "ward", "lat", "lon", "avg_temp", "annual_rainfall", "avg_aqi", "ndvi", "buildup_pct", "flood_risk")
    )


def landuse_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-cover shares per year from order status and priority."""

    def share(cond: Column, scale: float = 1.0) -> Column:
        return rnd(F.avg(F.when(cond, 1.0).otherwise(0.0)) * scale, YEARLY_DIGITS)

    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").alias("year"))
        .agg(
            share(status == "F").alias("ndvi"),
            share(status == "O", 100.0).alias("built_up_pct"),
            share(status == "P", 100.0).alias("vegetation_pct"),
            share(priority == "5-LOW", 100.0).alias("water_pct"),
            share(priority == "1-URGENT", 100.0).alias("bare_land_pct"),
            rnd(F.avg(F.col("o_totalprice") / 10000.0), YEARLY_DIGITS).alias("lst"),
        )
        .withColumn("region_id", F.lit("all"))
    )


def feed_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings: station, event time, pollutant, value."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("station_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("pollutant"),
        F.col("value"),
    )
