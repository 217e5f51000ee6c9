"""Column scaling with table-wide statistics.

Spark ML's scalers follow other conventions (a constant column maps to 0.5,
sample instead of population deviation), hence plain expressions. The
statistics are one row, computed map-side first, and travel as a scalar
subquery.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyria.functions.numeric import rescale, unscale
from zephyria.operators.columns import existing
from zephyria.operators.joins import table_row

_STATS = "_stats"


def ranges(df: DataFrame, cols: Sequence[str]) -> Column:
    """Struct of ``<column>_lo`` and ``<column>_hi`` over the whole table."""
    cols = existing(df, cols)
    return table_row(df, {f"{c}_{k}": f(c) for c in cols for k, f in (("lo", F.min), ("hi", F.max))})


def _bounds(c: str) -> tuple[Column, Column]:
    row = F.col(_STATS)
    return row[f"{c}_lo"], row[f"{c}_hi"]


def minmax(df: DataFrame, cols: Sequence[str], bounds: Column | None = None) -> DataFrame:
    cols = existing(df, cols)
    with_row = df.withColumn(_STATS, ranges(df, cols) if bounds is None else bounds)
    return with_row.withColumns({c: rescale(F.col(c), *_bounds(c)) for c in cols}).drop(_STATS)


def inverse_minmax(df: DataFrame, column: str, source: str, bounds: Column) -> DataFrame:
    """Bring ``column`` back to the units of ``source``, whose range is in ``bounds``."""
    with_row = df.withColumn(_STATS, bounds)
    return with_row.withColumn(column, unscale(F.col(column), *_bounds(source))).drop(_STATS)


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column is only centred."""
    cols = existing(df, cols)
    row = table_row(df, {f"{c}_{k}": f(c) for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))})

    def scaled(c: str) -> Column:
        mean, sd = F.col(_STATS)[f"{c}_m"], F.col(_STATS)[f"{c}_s"]
        return (F.col(c) - mean) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)

    return df.withColumn(_STATS, row).withColumns({c: scaled(c) for c in cols}).drop(_STATS)


def normalise(df: DataFrame, cols: Sequence[str], method: str = "minmax") -> DataFrame:
    return minmax(df, cols) if method == "minmax" else standardise(df, cols)
