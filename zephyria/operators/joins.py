"""Joins of the daily tables.

No join carries a broadcast hint: both sides grow with the data. Daily tables
are merged by (station, date); for smaller sides the size measured at run time
decides. Single-row statistics travel as scalar subqueries, whose size is one
row by definition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyria.operators.columns import calendar_columns, fill_constants
from zephyria.operators.series import KEYS, ORDER

DAILY_KEYS = (*KEYS, ORDER)
CALENDAR_KEYS = ("year", "month", "season")
MERGE_KEYS = (*DAILY_KEYS, *CALENDAR_KEYS)


def join_radiation(weather: DataFrame, radiation: DataFrame) -> DataFrame:
    """Keep every weather day; days without humidity or pressure get the defaults."""
    return fill_constants(weather.join(radiation.hint("merge"), list(DAILY_KEYS), "left"))


def join_weather_air(weather: DataFrame, air: DataFrame) -> DataFrame:
    """Days present in both tables whose calendar columns agree; clashes get a suffix.

    Calendar columns the air side lacks follow from its date, so they need not
    be join keys: checking the weather side against the date is the same, and
    two sides already sorted by (station, date) merge without another sort.
    Both tables grow with the data, so neither is ever broadcast.
    """
    stored = [c for c in CALENDAR_KEYS if c in air.columns]
    derived = calendar_columns()
    for c in CALENDAR_KEYS:
        if c not in stored:
            weather = weather.where(F.col(c) == derived[c])
    keys = [*DAILY_KEYS, *stored]
    clashes = (set(weather.columns) & set(air.columns)) - set(keys)
    air = air.withColumnsRenamed({c: f"{c}_aqi" for c in clashes})
    return weather.join(air.hint("merge"), keys, "inner")


def attach_air(df: DataFrame, air: DataFrame) -> DataFrame:
    """Add ``aqi`` and ``pm25`` where the table has no air quality yet."""
    if "aqi" in df.columns:
        return df
    return df.join(air.select(*DAILY_KEYS, "aqi", "pm25"), list(DAILY_KEYS), "left")


def with_key_stats(df: DataFrame, stats: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """Statistics per key on every row: aggregate map-side, then join back."""
    per_key = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(per_key, list(keys), "left")


def table_row(df: DataFrame, stats: Mapping[str, Column]) -> Column:
    """Statistics of the whole table as one struct-valued scalar subquery."""
    return df.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("stats")).scalar()


def with_table_stats(df: DataFrame, stats: Mapping[str, Column], name: str = "stats") -> DataFrame:
    """The table's own statistics on every row, as a struct column."""
    return df.withColumn(name, table_row(df, stats))
