"""Scalar climate indicators."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyria import config
from zephyria.functions.numeric import clip, guard, rnd


def heat_index(temp: Column, humidity: Column) -> Column:
    """Regression heat index in deg C above the threshold, else the temperature."""
    f = temp * 9.0 / 5.0 + 32.0

    def power(c: Column, n: int) -> list[Column]:
        return [c] * n

    terms = []
    for pt, ph, factor in config.HEAT_INDEX_TERMS:
        term = F.lit(factor)
        for c in power(f, pt) + power(humidity, ph):
            term = term * c
        terms.append(term)
    celsius = (reduce(add, terms) - 32.0) * 5.0 / 9.0
    return rnd(F.when(temp > config.HEAT_INDEX_FROM, celsius).otherwise(temp), 2)


def discomfort_index(temp: Column, humidity: Column) -> Column:
    return rnd(temp - F.lit(0.55) * (F.lit(1.0) - humidity / 100.0) * (temp - 14.5), 2)


def uhi_score(temp: Column, rural_base: float = config.RURAL_BASE_TEMP) -> Column:
    """Heat-island intensity over an assumed rural background, never negative."""
    return rnd(clip(temp - rural_base, lo=0), 2)


def pollution_severity(pm25: Column, aqi: Column) -> Column:
    return rnd(clip(pm25 / 300.0, 0, 1) * 0.6 + clip(aqi / 500.0, 0, 1) * 0.4, 3)


def vegetation_loss(ndvi: Column) -> Column:
    return rnd(clip(F.lit(config.HEALTHY_NDVI) - ndvi, 0, 1), 3)


def water_shrinkage(water: Column, historical_max: Column) -> Column:
    return rnd(clip((historical_max - water) / (historical_max + config.EPSILON), 0, 1), 3)


def ramp_colour(value: Column, lo: Column, hi: Column) -> Column:
    """Blue-to-red ``#rr40bb`` colour of a value within [lo, hi], channels truncated."""
    ratio = (value - lo) / (hi - lo + config.EPSILON)
    red = guard(ratio * 255.0).cast("int")
    blue = guard((F.lit(1.0) - ratio) * 255.0).cast("int")
    # format_string would print "null" for a missing value
    return F.when(value.isNotNull(), F.format_string("#%02x40%02x", red, blue))
