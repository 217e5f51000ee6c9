"""Human-health risk scores on a 0-100 scale, and their weighted composite."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyria import config
from zephyria.functions.numeric import clip, rnd


def _score(c: Column) -> Column:
    return rnd(clip(c, 0, 100), 1)


def heat_exhaustion(temp: Column, humidity: Column) -> Column:
    vapour = humidity / 100.0 * 6.105 * F.exp(temp * 17.27 / (temp + 237.7))
    felt = temp + vapour * 0.33 - 4.0
    return _score((felt - 27.0) / 20.0 * 100.0)


def dehydration(temp: Column, humidity: Column, wind: Column) -> Column:
    return _score((temp - 20.0) / 20.0 * 50.0 + (F.lit(100.0) - humidity) / 100.0 * 30.0 + wind / 40.0 * 20.0)


def respiratory(aqi: Column, pm25: Column) -> Column:
    return _score(pm25 / 250.0 * 60.0 + aqi / 500.0 * 40.0)


def flood_health(rain: Column, humidity: Column) -> Column:
    return _score(rain * 0.7 + humidity * 0.3)


def dengue_vector(temp: Column, rain: Column, humidity: Column) -> Column:
    off_optimum = (temp - 30.0) / 4.0
    warm = F.exp(off_optimum * off_optimum * -0.5)
    wet = clip(rain / 50.0, 0, 1)
    humid = clip((humidity - 50.0) / 50.0, 0, 1)
    return _score((warm * 0.5 + wet * 0.3 + humid * 0.2) * 100.0)


def sleep_disturb(temp_min: Column, humidity: Column) -> Column:
    return _score((temp_min - 20.0) / 15.0 * 60.0 + (humidity - 50.0) / 50.0 * 40.0)


def productivity(temp: Column, aqi: Column) -> Column:
    heat = clip((temp - 28.0) / 15.0 * 60.0, 0, 60)
    air = clip(aqi / 500.0 * 40.0, 0, 40)
    return _score(heat + air)


def risk_scores(inputs: dict[str, Column]) -> dict[str, Column]:
    """The seven scores from the named input columns, keyed as in the weights."""
    t, rh = inputs["temperature_mean"], inputs["humidity"]
    return {
        "heat_exhaustion": heat_exhaustion(t, rh),
        "dehydration": dehydration(t, rh, inputs["wind_speed"]),
        "respiratory": respiratory(inputs["aqi"], inputs["pm25"]),
        "flood_health": flood_health(inputs["rainfall"], rh),
        "dengue_vector": dengue_vector(t, inputs["rainfall"], rh),
        "sleep_disturb": sleep_disturb(inputs["temperature_min"], rh),
        "productivity": productivity(t, inputs["aqi"]),
    }


def composite(scores: dict[str, Column]) -> Column:
    """Weighted sum of the scores that are present (already rounded)."""
    parts = [scores[k] * w for k, w in config.HEALTH_WEIGHTS.items() if k in scores]
    return rnd(reduce(add, parts), 1)
