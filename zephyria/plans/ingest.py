"""Daily tables assembled from landed feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyria import config
from zephyria.operators.aggregates import daily_mean
from zephyria.operators.columns import add_calendar, existing
from zephyria.operators.gaps import fill_nearest, interpolate
from zephyria.operators.joins import join_radiation
from zephyria.operators.ordering import append, sort_series, union_cutover
from zephyria.sources.feeds import clean_parameters, clip_feed_ranges, co_to_mg


def radiation_table(parameters: DataFrame) -> DataFrame:
    """Sentinels and units, then an inner fill (leading gaps stay), then the clamps."""
    filled = interpolate(clean_parameters(parameters), ["humidity", "pressure"], leading=False)
    return clip_feed_ranges(filled)


def assemble_weather(daily: DataFrame, parameters: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Weather feed with radiation parameters, optional later days, calendar columns."""
    joined = join_radiation(fill_nearest(daily), radiation_table(parameters))
    if extra is not None:
        joined = append(joined, extra)
    return sort_series(add_calendar(joined))


def daily_air(hourly: DataFrame) -> DataFrame:
    """Hourly readings to filled daily means."""
    readings = hourly.withColumn("co", co_to_mg(F.col("co")))
    return fill_nearest(daily_mean(readings, existing(hourly, config.AIR_COLUMNS)))


def assemble_air(
    hourly: DataFrame, history: DataFrame | None = None, cut: str = config.AIR_OBSERVED_FROM, until: str | None = None
) -> DataFrame:
    """Observed air quality from the cut-over date on, history before it."""
    observed = daily_air(hourly)
    return sort_series(observed if history is None else union_cutover(history, observed, cut, until))
