"""Class labels and label codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyria.catalog import sqltext as q
from zephyria.catalog.column_queries import KEY, obs
from zephyria.catalog.registry import query
from zephyria.functions import classes
from zephyria.operators.columns import add_calendar, add_risk_ordinals, encode_labels
from zephyria.plans.daily import label_weather, score_health


def _labels(*pairs: str) -> str:
    return q.with_(q.OBS, q.DAILY) + f"select station_id, date, {', '.join(pairs)} from daily"


@query("classify_temperature", _labels("temperature_mean", f"{q.temp_class('temperature_mean')} as temp_class"))
def classify_temperature(spark, sf):
    return obs(spark, sf).select(*KEY, "temperature_mean", classes.temperature_class(F.col("temperature_mean")).alias("temp_class"))


@query("classify_rainfall", _labels("rainfall", f"{q.rain_class('rainfall')} as rain_class"))
def classify_rainfall(spark, sf):
    return obs(spark, sf).select(*KEY, "rainfall", classes.rainfall_class(F.col("rainfall")).alias("rain_class"))


@query(
    "classify_aqi",
    _labels(
        "aqi",
        f"{q.aqi_class('aqi')} as aqi_class",
        """case when aqi>=0 and aqi<51 then 'Good' when aqi>=51 and aqi<101 then 'Moderate'
 when aqi>=101 and aqi<201 then 'Poor' else 'Very Poor' end as aqi_class_contiguous""",
    ),
)
def classify_aqi(spark, sf):
    return obs(spark, sf).select(
        *KEY,
        "aqi",
        classes.aqi_class(F.col("aqi")).alias("aqi_class"),
        classes.aqi_class(F.col("aqi"), contiguous=True).alias("aqi_class_contiguous"),
    )


@query("classify_flood_risk", _labels("rainfall", "humidity", f"{q.flood_risk('rainfall', 'humidity')} as flood_risk"))
def classify_flood_risk(spark, sf):
    risk = classes.flood_risk(F.col("rainfall"), F.col("humidity"))
    return obs(spark, sf).select(*KEY, "rainfall", "humidity", risk.alias("flood_risk"))


@query(
    "classify_health_risk", _labels(f"{q.health_risk('temperature_mean', 'aqi', 'humidity')} as health_risk")
)
def classify_health_risk(spark, sf):
    risk = classes.health_risk(F.col("temperature_mean"), F.col("aqi"), F.col("humidity"))
    return obs(spark, sf).select(*KEY, risk.alias("health_risk"))


@query(
    "classify_dengue_risk", _labels(f"{q.dengue_risk('temperature_mean', 'rainfall', 'humidity')} as dengue_risk")
)
def classify_dengue_risk(spark, sf):
    risk = classes.dengue_risk(F.col("temperature_mean"), F.col("rainfall"), F.col("humidity"))
    return obs(spark, sf).select(*KEY, risk.alias("dengue_risk"))


@query(
    "risk_label",
    q.with_(q.OBS, *q.scored("obs", "sc", "station_id, date"))
    + "select station_id, date, health_risk_score, health_risk_label from sc",
)
def risk_label(spark, sf):
    return score_health(obs(spark, sf)).select(*KEY, "health_risk_score", "health_risk_label")


@query(
    "aqi_ordinal",
    q.with_(q.OBS)
    + f"""select station_id, date, aqi_class, {q.coded('aqi_class', q.AQI_LABELS, 1)} as aqi_ordinal
 from (select *, case when o3 > 140 then 'Hazardous' when o3 > 120 then null else {q.aqi_class('aqi')} end as aqi_class from obs) z""",
)
def aqi_ordinal(spark, sf):
    """Days with much ozone carry an unknown or a missing label."""
    label = (
        F.when(F.col("o3") > 140, "Hazardous")
        .when(F.col("o3") > 120, F.lit(None).cast("string"))
        .otherwise(classes.aqi_class(F.col("aqi")))
    )
    days = obs(spark, sf).select(*KEY, label.alias("aqi_class"))
    return days.withColumn("aqi_ordinal", classes.aqi_ordinal(F.col("aqi_class")))


@query("season_code", _labels("season", f"{q.coded('season', q.SEASONS, 0)} as season_code"))
def season_code(spark, sf):
    days = add_calendar(obs(spark, sf).select(*KEY), ("season",))
    return days.withColumn("season_code", classes.season_code(F.col("season")))


@query(
    "risk_ordinals",
    q.with_(
        q.OBS,
        f"""l as (select station_id, date, {q.temp_class('temperature_mean')} as temp_class,
 {q.rain_class('rainfall')} as rain_class, {q.flood_risk('rainfall', 'humidity')} as flood_risk,
 {q.health_risk('temperature_mean', 'aqi', 'humidity')} as health_risk,
 {q.dengue_risk('temperature_mean', 'rainfall', 'humidity')} as dengue_risk from obs)""",
    )
    + f"select station_id, date, {', '.join(f'{q.coded(k, v, 0)} as {k}_ordinal' for k, v in q.ORDINALS.items())} from l",
)
def risk_ordinals(spark, sf):
    t, rh = F.col("temperature_mean"), F.col("humidity")
    labelled = label_weather(obs(spark, sf)).withColumns(
        {
            "health_risk": classes.health_risk(t, F.col("aqi"), rh),
            "dengue_risk": classes.dengue_risk(t, F.col("rainfall"), rh),
        }
    )
    return add_risk_ordinals(labelled).select(*KEY, *[f"{k}_ordinal" for k in q.ORDINALS])


@query(
    "label_encode",
    q.with_(
        q.OBS,
        f"l as (select station_id, date, {q.rain_class('rainfall')} as rain_class from obs)",
        "v as (select rain_class, dense_rank() over (order by rain_class) - 1 as code from (select distinct rain_class from l) d)",
    )
    + "select station_id, date, rain_class, cast(code as integer) as code from l join v using (rain_class)",
)
def label_encode(spark, sf):
    days = obs(spark, sf).select(*KEY, classes.rainfall_class(F.col("rainfall")).alias("rain_class"))
    return encode_labels(days, "rain_class", "code")
