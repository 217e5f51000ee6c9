"""Declared schemas of the stored tables and of the landed feeds."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*specs: str) -> T.StructType:
    kinds = {"d": T.DoubleType(), "i": T.IntegerType(), "s": T.StringType(), "date": T.DateType(), "l": T.LongType()}
    out = T.StructType()
    for spec in specs:
        name, kind = spec.split(":")
        out.add(name, kinds[kind])
    return out


WEATHER = _fields(
    "station_id:l",
    "date:date",
    *[f"{c}:d" for c in ("temperature_max", "temperature_min", "temperature_mean", "rainfall", "wind_speed")],
    *[f"{c}:d" for c in ("apparent_temp", "humidity", "pressure", "solar")],
    *[f"{c}:i" for c in ("year", "month", "day", "doy")],
    "season:s",
)
AIR = _fields("station_id:l", "date:date", *[f"{c}:d" for c in ("pm25", "pm10", "no2", "so2", "co", "o3", "aqi")])
LAND_USE = _fields(
    "region_id:s",
    "year:i",
    *[f"{c}:d" for c in ("ndvi", "ndbi", "ndwi", "lst")],
    *[f"{c}:d" for c in ("built_up_pct", "vegetation_pct", "water_pct", "bare_land_pct")],
)
WARD = _fields(
    "year:i",
    "ward:s",
    *[f"{c}:d" for c in ("lat", "lon", "avg_temp", "annual_rainfall", "avg_aqi", "ndvi", "buildup_pct", "population_den")],
    *[f"{c}:s" for c in ("flood_risk", "health_risk", "dengue_risk")],
)

# --- landed feeds -----------------------------------------------------------
# FIXED VALUES: feed field name -> table column
DAILY_FEED_FIELDS = {
    "temperature_2m_max": "temperature_max",
    "temperature_2m_min": "temperature_min",
    "temperature_2m_mean": "temperature_mean",
    "precipitation_sum": "rainfall",
    "windspeed_10m_max": "wind_speed",
    "apparent_temperature_mean": "apparent_temp",
}
HOURLY_FEED_FIELDS = {
    "pm2_5": "pm25",
    "pm10": "pm10",
    "carbon_monoxide": "co",
    "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2",
    "ozone": "o3",
    "european_aqi": "aqi",
}
PARAMETER_FEED_FIELDS = {"RH2M": "humidity", "PS": "pressure", "ALLSKY_SFC_SW_DWN": "solar"}


def _array_feed(block: str, fields: dict[str, str]) -> T.StructType:
    arrays = T.StructType([T.StructField("time", T.ArrayType(T.StringType()))])
    for name in fields:
        arrays.add(name, T.ArrayType(T.DoubleType()))
    return T.StructType([T.StructField("station_id", T.LongType()), T.StructField(block, arrays)])


DAILY_FEED = _array_feed("daily", DAILY_FEED_FIELDS)
HOURLY_FEED = _array_feed("hourly", HOURLY_FEED_FIELDS)
PARAMETER_FEED = T.StructType(
    [
        T.StructField("station_id", T.LongType()),
        T.StructField(
            "properties",
            T.StructType(
                [T.StructField("parameter", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))]
            ),
        ),
    ]
)

METRIC = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("RMSE", T.DoubleType()),
        T.StructField("MAE", T.DoubleType()),
        T.StructField("R2", T.DoubleType()),
        T.StructField("Accuracy", T.DoubleType()),
        T.StructField("F1_weighted", T.DoubleType()),
        T.StructField("ConfusionMatrix", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)
NUMERIC_METRICS = ("RMSE", "MAE", "R2", "Accuracy", "F1_weighted")
