"""Seasonal, monthly, annual and KPI summaries.

Grouping columns are few (seasons, months, years), so every summary is built
from aggregates that merge map-side; a season holding most of the rows costs
one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from zephyria import config
from zephyria.functions.calendar import month_name
from zephyria.functions.numeric import clip, guard, rnd
from zephyria.functions.text import display_name
from zephyria.operators.columns import existing, with_prefix
from zephyria.operators.ordering import last_rows_per_key
from zephyria.operators.quantiles import quantiles
from zephyria.operators.series import KEYS

LONG_STATS = ("mean", "std", "min", "max")


MEAN_DIGITS = 6  # of a mean that is not rounded for display


def mean_of(c: str | Column, digits: int = MEAN_DIGITS) -> Column:
    return rnd(F.avg(c), digits)


def means(df: DataFrame, cols: Sequence[str], by: Sequence[str], digits: int = MEAN_DIGITS) -> DataFrame:
    return df.groupBy(*by).agg(*[mean_of(c, digits).alias(c) for c in existing(df, cols)])


def daily_mean(readings: DataFrame, cols: Sequence[str], ts: str = "ts", keys: Sequence[str] = KEYS) -> DataFrame:
    """Calendar-day means of hourly readings."""
    return readings.groupBy(*keys, F.to_date(ts).alias(config.DATE)).agg(*[mean_of(c).alias(c) for c in cols])


def _known_seasons(df: DataFrame) -> DataFrame:
    return df.where(F.col("season").isin(*config.SEASON_MONTHS))


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., variable, n, mean, std, min, max), unpivoted after the aggregation."""
    aggs = []
    for c in cols:
        aggs += [
            F.struct(
                F.lit(c).alias("variable"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
            ).alias(f"_{c}")
        ]
    grouped = df.groupBy(*by).agg(*aggs)
    return grouped.select(*by, F.inline(F.array(*[F.col(f"_{c}") for c in cols])))


def distribution(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str],
    probs: Mapping[str, float],
    digits: int,
    few_groups: bool = False,
) -> DataFrame:
    """Moments and exact quantiles per group and variable, in long form."""
    values = df.select(*by, *cols).unpivot(list(by), list(cols), "variable", "value")
    order_stats = quantiles(values, "value", probs, [*by, "variable"], few_groups=few_groups)
    joined = moments(df, cols, by).join(order_stats, [*by, "variable"], "left")
    return joined.select(
        *by, "variable", "n", *[rnd(F.col(c), digits).alias(c) for c in (*LONG_STATS, *probs)]
    )


def seasonal_stats(df: DataFrame, cols: Sequence[str] = config.SEASONAL_COLUMNS) -> DataFrame:
    """Mean, sample deviation, min, max and median per known season and variable.

    The four known seasons times the named columns bound the number of groups.
    """
    return distribution(_known_seasons(df), existing(df, cols), ["season"], {"median": 0.5}, 2, few_groups=True).drop("n")


def seasonal_box(df: DataFrame, column: str = "temperature_mean") -> DataFrame:
    """Box-plot figures of one column per season; seasons without values are absent."""
    present = _known_seasons(df).where(F.col(column).isNotNull())
    return distribution(present, [column], ["season"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, 4, few_groups=True)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, range and quartiles of each column."""
    return distribution(df, cols, [], {"p25": 0.25, "p50": 0.5, "p75": 0.75}, 2, few_groups=True)


def monthly_climatology(df: DataFrame) -> DataFrame:
    return means(df, config.MONTHLY_COLUMNS, ["month"], 2)


def annual_means(df: DataFrame, cols: Sequence[str] = config.TREND_COLUMNS, digits: int = 2) -> DataFrame:
    return means(df, cols, ["year"], digits)


def _all_years() -> WindowSpec:
    """An annual table has one row per calendar year, so one group is enough."""
    return Window.partitionBy(F.lit(0))


def annual_trend(df: DataFrame, cols: Sequence[str] = config.TREND_COLUMNS) -> DataFrame:
    """Annual means and, on every row, the least-squares slope of each column.

    The slope is fitted to the rounded means; with fewer than two years it is NULL.
    """
    annual = annual_means(df, cols)
    year = F.col("year").cast("double")
    return annual.withColumns(
        {
            f"{c}_trend_slope": rnd(
                F.when(F.count(c).over(_all_years()) > 1, F.regr_slope(F.col(c), year).over(_all_years())), 4
            )
            for c in existing(annual, cols)
        }
    )


def trend_line(df: DataFrame, column: str = "temperature_mean") -> DataFrame:
    """Annual means with the fitted straight line (means not rounded)."""
    annual = annual_means(df, [column], MEAN_DIGITS)
    y, year = F.col(column), F.col("year").cast("double")
    slope = F.regr_slope(y, year).over(_all_years())
    # fitted around the centre: an intercept at year 0 would cancel digits
    centre_y = F.avg(F.when(y.isNotNull(), y)).over(_all_years())
    centre_x = F.avg(F.when(y.isNotNull(), year)).over(_all_years())
    return annual.select("year", rnd(y, MEAN_DIGITS).alias(column), rnd(centre_y + slope * (year - centre_x), MEAN_DIGITS).alias("trend"))


def risk_shares(df: DataFrame, risk: str, levels: Sequence[str]) -> DataFrame:
    """Season by risk level, as shares of the season's labelled days."""
    labelled = df.where(F.col("season").isNotNull() & F.col(risk).isNotNull())
    counts = labelled.groupBy("season").pivot(risk, list(levels)).count()
    total = sum((F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in levels), F.lit(0))
    return counts.select(
        "season", *[rnd(F.try_divide(F.coalesce(F.col(f"`{v}`"), F.lit(0)), total), 3).alias(v) for v in levels]
    )


def flood_shares(df: DataFrame) -> DataFrame:
    return risk_shares(df, "flood_risk", list(config.RISK_CODES["flood_risk"][0]))


def dengue_shares(df: DataFrame) -> DataFrame:
    return risk_shares(df, "dengue_risk", list(config.RISK_CODES["dengue_risk"][0]))


def aqi_by_month(df: DataFrame) -> DataFrame:
    return means(df, ["aqi"], ["year", "month"], 1)


def aqi_matrix(df: DataFrame) -> DataFrame:
    """Year by month mean air quality; months without data are 0."""
    wide = df.groupBy("year").pivot("month", list(range(1, 13))).agg(F.avg("aqi"))
    return wide.select(
        "year",
        *[rnd(F.coalesce(F.col(f"`{m}`"), F.lit(0.0)), MEAN_DIGITS).alias(n) for m, n in enumerate(config.MONTH_NAMES, 1)],
    )


def annual_rain(df: DataFrame) -> DataFrame:
    """Rain per year; a year without readings is 0."""
    return df.groupBy("year").agg(guard(F.coalesce(F.sum("rainfall"), F.lit(0.0))).alias("rainfall"))


def mean_annual_rain(df: DataFrame) -> DataFrame:
    return annual_rain(df).agg(mean_of("rainfall").alias("avg_annual_rain"))


def annual_pollutants(df: DataFrame) -> DataFrame:
    return means(df, config.POLLUTANT_COLUMNS, ["year"])


def annual_heat_island(df: DataFrame) -> DataFrame:
    """Annual mean temperature above the mean of the first years, never negative."""
    annual = annual_means(df, ["temperature_mean"], MEAN_DIGITS)
    ordered = _all_years().orderBy("year")
    early = F.when(F.col("_nth") <= config.BASELINE_YEARS, F.col("temperature_mean"))
    base = F.avg(early).over(_all_years())
    return annual.withColumn("_nth", F.row_number().over(ordered)).select(
        "year",
        "temperature_mean",
        guard(clip(F.col("temperature_mean") - base, lo=0)).alias("uhi"),
    )


def monthly_rain(df: DataFrame) -> DataFrame:
    return means(df, ["rainfall"], ["month"]).withColumn("month_name", month_name(F.col("month")))


def kpi_overview(weather: DataFrame, air: DataFrame, land: DataFrame) -> DataFrame:
    """One row from three tables; each figure is a one-row subquery."""
    return weather.agg(mean_of("temperature_mean").alias("mean_temp")).select(
        "mean_temp",
        mean_annual_rain(weather).scalar().alias("avg_annual_rain"),
        air.agg(mean_of("aqi")).scalar().alias("mean_aqi"),
        land.agg(F.max_by("ndvi", "year")).scalar().alias("ndvi_latest"),
    )


def kpi_temperature(df: DataFrame) -> DataFrame:
    return df.agg(
        F.max("temperature_max").alias("max_temp"),
        mean_of("temperature_mean").alias("mean_temp"),
        F.min("temperature_min").alias("min_temp"),
        F.count_if(F.col("temperature_max") > config.HEAT_WAVE_ABOVE).alias("heat_wave_days"),
    )


def kpi_rain(df: DataFrame) -> DataFrame:
    """Totals come from the year roll-up, so one pass over the days is enough."""
    per_year = df.groupBy("year").agg(
        F.coalesce(F.sum("rainfall"), F.lit(0.0)).alias("total"),
        F.max("rainfall").alias("peak"),
        F.count_if(F.col("rainfall") > config.RAINY_ABOVE).alias("rainy"),
        F.count_if(F.col("rainfall") > config.EXTREME_RAIN_ABOVE).alias("extreme"),
    )
    years = F.greatest(F.count("year"), F.lit(1))
    return per_year.agg(
        mean_of("total").alias("avg_annual_rain"),
        F.max("peak").alias("max_rain"),
        F.floor(F.coalesce(F.sum("rainy"), F.lit(0)) / years).alias("rainy_days_per_year"),
        F.coalesce(F.sum("extreme"), F.lit(0)).alias("extreme_events"),
    )


def kpi_air(df: DataFrame) -> DataFrame:
    return df.agg(
        *[mean_of(c).alias(f"mean_{c}") for c in ("aqi", "pm25", "no2")],
        F.count_if(F.col("aqi") > config.POOR_AIR_ABOVE).alias("poor_air_days"),
    )


def kpi_land(df: DataFrame) -> DataFrame:
    return df.agg(
        *[
            pick(c, "year").alias(f"{c}_{edge}")
            for c in ("built_up_pct", "ndvi")
            for edge, pick in (("first", F.min_by), ("last", F.max_by))
        ]
    )


def risk_profile(df: DataFrame, rows: int = config.RISK_WINDOW_ROWS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of each risk score over a series' last rows, with display names."""
    risks = with_prefix(df, "risk_")
    recent = last_rows_per_key(df.select(*keys, config.DATE, *risks), rows, keys)
    wide = recent.groupBy(*keys).agg(*[mean_of(c).alias(c) for c in risks])
    long = wide.unpivot(list(keys), risks, "risk", "mean_score")
    return long.withColumn("label", display_name(F.col("risk"), "risk_"))


def tail_means(
    df: DataFrame, cols: Sequence[str] = ("humidity", "pressure"), rows: int = 30, keys: Sequence[str] = KEYS
) -> DataFrame:
    recent = last_rows_per_key(df.select(*keys, config.DATE, *cols), rows, keys)
    return recent.groupBy(*keys).agg(*[mean_of(c).alias(f"{c}_mean") for c in cols])


def land_shares(df: DataFrame) -> DataFrame:
    """Land classes per year in long form, for stacking."""
    cols = existing(df, config.LAND_CLASS_LABELS)
    long = df.unpivot(["year"], cols, "land_class", "share_pct")
    names = F.create_map(*[F.lit(x) for item in config.LAND_CLASS_LABELS.items() for x in item])
    return long.withColumn("label", names[F.col("land_class")])


def greenness_and_heat(df: DataFrame) -> DataFrame:
    return df.select("year", "ndvi", "lst").orderBy("year")
