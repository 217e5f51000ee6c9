"""Ward and land-use operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyria import config
from zephyria.functions.indicators import ramp_colour, vegetation_loss, water_shrinkage
from zephyria.functions.numeric import guard
from zephyria.operators.aggregates import mean_of, means
from zephyria.operators.columns import existing
from zephyria.operators.joins import table_row, with_key_stats
from zephyria.operators.quantiles import quantiles
from zephyria.operators.windows import difference, first_per_key, loss_since_first, running_max

REGION = ("region_id",)


def ward_means(df: DataFrame, cols: Sequence[str] = (*config.WARD_FEATURES, "lat", "lon")) -> DataFrame:
    """Means per ward over all years."""
    return means(df, cols, ["ward"])


def heat_hotspots(df: DataFrame, percentile: float = 75) -> DataFrame:
    """Wards at or above the interpolated percentile of ward temperature."""
    wards = ward_means(df, config.HOTSPOT_COLUMNS)
    threshold = quantiles(wards, "avg_temp", {"threshold": percentile / 100}).scalar()
    return wards.withColumn("is_uhi_hotspot", (F.col("avg_temp") >= guard(threshold)).cast("int"))


def ward_points(df: DataFrame, value: str) -> DataFrame:
    """Ward position and mean value for a heat map; incomplete wards are left out."""
    return ward_means(df, [value, "lat", "lon"]).dropna()


def ward_colours(df: DataFrame, value: str) -> DataFrame:
    """Ward mean values with their place on the table's colour ramp."""
    wards = ward_means(df, [value, "lat", "lon"])
    coloured = wards.withColumn("_range", table_row(wards, {"lo": F.min(value), "hi": F.max(value)}))
    colour = ramp_colour(F.col(value), F.col("_range.lo"), F.col("_range.hi"))
    return coloured.withColumn("colour", colour).drop("_range")


def ward_latest(df: DataFrame) -> DataFrame:
    """Per ward the last known value of every column."""
    rest = [c for c in df.columns if c != "ward"]
    year = F.col("year")
    return df.groupBy("ward").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), year)).alias(c) for c in rest])


def ward_flood_point(df: DataFrame) -> DataFrame:
    """Last flood risk, mean position and marker colour per ward."""
    colours, default = config.FLOOD_COLOURS
    known = F.create_map(*[F.lit(x) for item in colours.items() for x in item])
    risk = F.max_by("flood_risk", F.when(F.col("flood_risk").isNotNull(), F.col("year")))
    points = df.groupBy("ward").agg(
        risk.alias("flood_risk"), mean_of("lat").alias("lat"), mean_of("lon").alias("lon")
    )
    return points.withColumn("colour", F.coalesce(F.try_element_at(known, F.col("flood_risk")), F.lit(default)))


def high_flood_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("flood_risk") == "High").select(
        *existing(df, ("year", "ward", "lat", "lon", "avg_temp", "annual_rainfall", "flood_risk"))
    )


def flood_prone_wards(df: DataFrame) -> DataFrame:
    """Each high-risk ward once, with the figures of its earliest such year."""
    return first_per_key(high_flood_rows(df), ["ward"], "year").drop("year")


def water_loss(df: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Water lost against the first year, and the worst loss so far."""
    lost = loss_since_first(df, "water_pct", "water_loss_pct", keys, "year")
    worst = running_max(lost, "water_loss_pct", "cumulative_loss", keys, "year")
    return worst.select("year", "water_pct", "water_loss_pct", "cumulative_loss")


def yearly_change(df: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    changed = difference(
        df, {"ndvi_change": ("ndvi", 4), "buildup_change": ("built_up_pct", 2)}, keys, "year"
    )
    return changed.select("year", "ndvi", "ndvi_change", "built_up_pct", "buildup_change", "vegetation_pct")


def land_scores(df: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Vegetation loss against a healthy cover, water loss against the record high."""
    peaks = with_key_stats(df, {"_peak": F.max("water_pct")}, keys)
    return peaks.select(
        *keys,
        "year",
        "ndvi",
        "water_pct",
        vegetation_loss(F.col("ndvi")).alias("vegetation_loss_score"),
        water_shrinkage(F.col("water_pct"), F.col("_peak")).alias("water_body_shrinkage"),
    )
