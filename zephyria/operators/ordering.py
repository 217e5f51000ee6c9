"""Sorting, first/last rows, unions and the calendar spine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyria import config
from zephyria.operators.columns import split_at
from zephyria.operators.series import KEYS, ORDER, backward, forward


def sort_series(df: DataFrame, order: str = ORDER, keys: Sequence[str] = KEYS) -> DataFrame:
    """Total order by date, then key: a range-partitioned sort."""
    return df.orderBy(order, *[k for k in keys if k in df.columns])


def last_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The table's last n rows: a per-task top-n followed by one merge."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() for c in order]).limit(n)


def last_rows_per_key(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Each series' last n rows; Spark pushes the rank limit below the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(backward(keys, order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def first_rows_per_key(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(forward(keys, order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def edge_row_per_key(df: DataFrame, keys: Sequence[str], order: str, last: bool = True) -> DataFrame:
    """The first or last row per key by a map-side merging aggregate."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    pick = F.max_by(rest, F.col(order)) if last else F.min_by(rest, F.col(order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def union_cutover(
    history: DataFrame,
    observed: DataFrame,
    cut: str = config.AIR_OBSERVED_FROM,
    until: str | None = None,
    order: str = ORDER,
) -> DataFrame:
    """History before the cut-over date, observations from it on.

    ``until`` names the last wanted day; later rows of either side are dropped.
    """
    before, _ = split_at(history, cut, order)
    _, after = split_at(observed, cut, order)
    out = before.unionByName(after, allowMissingColumns=True)
    return out if until is None else out.where(F.col(order) <= F.lit(until).cast("date"))


def append(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Append rows; columns missing on either side are NULL."""
    return df.unionByName(extra, allowMissingColumns=True)


def year_days(years: DataFrame) -> DataFrame:
    """All days of the years ``first_year``..``last_year`` of a one-row table."""
    start = F.make_date(F.col("first_year"), F.lit(1), F.lit(1))
    end = F.make_date(F.col("last_year"), F.lit(12), F.lit(31))
    return years.select(F.explode(F.sequence(start, end)).alias(ORDER))


def date_spine(df: DataFrame, order: str = ORDER) -> DataFrame:
    """Every day of the years the table covers, with its number of rows (0 = gap)."""
    spine = year_days(df.agg(F.year(F.min(order)).alias("first_year"), F.year(F.max(order)).alias("last_year")))
    per_day = df.groupBy(F.col(order).alias(ORDER)).agg(F.count("*").alias("n_rows"))
    return spine.join(per_day, ORDER, "left").fillna({"n_rows": 0})
