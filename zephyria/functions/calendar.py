"""Date-derived columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyria import config


def date_parts(date: Column) -> dict[str, Column]:
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "doy": F.dayofyear(date),
    }


def season_of(month: Column) -> Column:
    out = None
    for season, months in config.SEASON_MONTHS.items():
        branch = month.isin(*months)
        out = F.when(branch, season) if out is None else out.when(branch, season)
    return out.otherwise(config.UNKNOWN_SEASON)


def season_flag_name(season: str) -> str:
    return "season_" + season.replace(" ", "_")


def season_flags(season: Column) -> dict[str, Column]:
    """One 0/1 column per season; an unknown or missing season is 0 everywhere."""
    return {
        season_flag_name(s): F.coalesce(season == s, F.lit(False)).cast("int")
        for s in config.SEASON_MONTHS
    }


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in config.MONTH_NAMES]), month)
