"""Cleaning, merging, feature and risk chains over the daily tables.

Each chain leaves the rows hashed by station, so clean_weather, clean_air,
merge_daily and engineer_features together shuffle every input once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyria import config
from zephyria.functions import classes, health, indicators
from zephyria.operators.columns import add_risk_ordinals, add_season_flags, existing, health_inputs
from zephyria.operators.gaps import clean_series
from zephyria.operators.joins import join_weather_air
from zephyria.operators.windows import lag_filled, rolling_anomaly, rolling_mean


def label_weather(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "temp_class": classes.temperature_class(F.col("temperature_mean")),
            "rain_class": classes.rainfall_class(F.col("rainfall")),
            "flood_risk": classes.flood_risk(F.col("rainfall"), F.col("humidity")),
        }
    )


def clean_weather(df: DataFrame) -> DataFrame:
    """Fill and de-spike, label, flag the season, add 7 and 30 day means."""
    cleaned = clean_series(df, config.WEATHER_OUTLIER_COLUMNS)
    rolled = {
        f"{c}_{n}d_avg": (c, n, 2) for c in existing(df, config.ROLLED_COLUMNS) for n in (7, 30)
    }
    return cleaned.transform(label_weather).transform(add_season_flags).transform(rolling_mean, rolled)


def clean_air(df: DataFrame) -> DataFrame:
    cleaned = clean_series(df, config.AIR_COLUMNS)
    labelled = cleaned.withColumn("aqi_class", classes.aqi_class(F.col("aqi")))
    return rolling_mean(labelled, {"aqi_7d_avg": ("aqi", 7, 1)})


def merge_daily(weather: DataFrame, air: DataFrame) -> DataFrame:
    """Join weather and air by day and label the joint risks."""
    t, rh = F.col("temperature_mean"), F.col("humidity")
    return join_weather_air(weather, air).withColumns(
        {
            "health_risk": classes.health_risk(t, F.col("aqi"), rh),
            "dengue_risk": classes.dengue_risk(t, F.col("rainfall"), rh),
        }
    )


def engineer_features(df: DataFrame) -> DataFrame:
    """Indicators, label codes, rolling anomaly and filled lags."""
    t, rh = F.col("temperature_mean"), F.col("humidity")
    scalars = {
        "heat_index": indicators.heat_index(t, rh),
        "discomfort_index": indicators.discomfort_index(t, rh),
        "uhi_score": indicators.uhi_score(t),
        "pollution_severity": indicators.pollution_severity(F.col("pm25"), F.col("aqi")),
        "season_code": classes.season_code(F.col("season")),
    }
    if "aqi_class" in df.columns:
        scalars["aqi_ordinal"] = classes.aqi_ordinal(F.col("aqi_class"))
    lags = {f"{c}_lag{k}": (c, k) for c in existing(df, config.LAGGED_COLUMNS) for k in (1, 7)}
    return (
        df.withColumns(scalars)
        .transform(add_risk_ordinals)
        .transform(rolling_anomaly, "rainfall", "rainfall_anomaly")
        .transform(lag_filled, lags)
    )


def score_health(df: DataFrame) -> DataFrame:
    """Seven risk scores, their composite and its label: one projection, no shuffle."""
    scores = health.risk_scores(health_inputs(df))
    scored = df.withColumns({f"risk_{k}": c for k, c in scores.items()})
    total = health.composite({k: F.col(f"risk_{k}") for k in scores})
    return scored.withColumn("health_risk_score", total).withColumn(
        "health_risk_label", classes.risk_label(F.col("health_risk_score"))
    )
