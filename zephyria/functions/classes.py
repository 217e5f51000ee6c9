"""Label columns: band classes, risk classes, label codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyria import config
from zephyria.functions.numeric import guard


def _band(c: Column, bands: Sequence[tuple[str, float, float]], closed: bool) -> Column:
    """First band containing ``c``; outside all of them (or NULL) the last label."""
    out = F
    for label, lo, hi in bands:
        inside = (c >= F.lit(float(lo))) & ((c <= F.lit(float(hi))) if closed else (c < F.lit(float(hi))))
        out = out.when(inside, label)
    return out.otherwise(bands[-1][0])


def _below(score: Column, steps: Sequence[tuple[float, str]], top: str, inclusive: bool = False) -> Column:
    """Label of the first step not exceeded; a missing score falls to ``top``."""
    out = F
    for limit, label in steps:
        bound = F.lit(float(limit))
        out = out.when(score <= bound if inclusive else score < bound, label)
    return out.otherwise(top)


def temperature_class(t: Column) -> Column:
    return _band(t, config.TEMPERATURE_BANDS, closed=False)


def rainfall_class(r: Column) -> Column:
    return _band(r, config.RAINFALL_BANDS, closed=False)


def aqi_class(a: Column, contiguous: bool = False) -> Column:
    """Air-quality band.

    The bands have whole-number edges, so a fractional index such as 50.5 lies
    in none of them and takes the worst label. ``contiguous=True`` closes the
    gaps by extending each band up to the start of the next one.
    """
    if not contiguous:
        return _band(a, config.AQI_BANDS, closed=True)
    lows = [lo for _, lo, _ in config.AQI_BANDS[1:]] + [config.AQI_BANDS[-1][2]]
    return _band(a, [(n, lo, nxt) for (n, lo, _), nxt in zip(config.AQI_BANDS, lows)], closed=False)


def flood_risk(rain: Column, humidity: Column) -> Column:
    score = guard(rain * 0.7 + humidity * 0.3)
    return _below(score, config.FLOOD_STEPS, config.FLOOD_TOP)


def health_risk(temp: Column, aqi: Column, humidity: Column) -> Column:
    score = guard(temp / 45.0 * 40.0 + aqi / 500.0 * 40.0 + humidity / 100.0 * 20.0)
    return risk_label(score)


def dengue_risk(temp: Column, rain: Column, humidity: Column) -> Column:
    points = (
        F.when(temp.between(25.0, 35.0), 2).otherwise(0)
        + F.when(rain > 10.0, 2).otherwise(0)
        + F.when(humidity > 70.0, 1).otherwise(0)
    )
    return _below(points, config.DENGUE_STEPS, config.DENGUE_TOP, inclusive=True)


def risk_label(score: Column) -> Column:
    return _below(score, config.HEALTH_STEPS, config.HEALTH_TOP)


def code_of(label: Column, codes: Mapping[str, int], default: int) -> Column:
    """Dictionary lookup with a default for unknown and missing labels."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    # try_element_at is NULL for an absent key, also under ANSI mode
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(default))


def aqi_ordinal(label: Column) -> Column:
    return code_of(label, *config.AQI_CODES)


def season_code(season: Column) -> Column:
    return code_of(season, *config.SEASON_CODES)


def risk_ordinal(kind: str, label: Column) -> Column:
    return code_of(label, *config.RISK_CODES[kind])
