"""Gap filling and outlier blanking on ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyria import config
from zephyria.functions.numeric import guard
from zephyria.operators.columns import double_columns, existing, measures_as_double
from zephyria.operators.series import KEYS, ORDER, backward, forward, so_far, whole


def _nearest(c: Column, window) -> Column:
    return F.last(c, ignorenulls=True).over(so_far(window))


def fill_nearest(
    df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = KEYS, order: str = ORDER
) -> DataFrame:
    """Carry the last value forward, then the first value back over a leading gap."""
    if cols is None:
        df = measures_as_double(df)
    cols = double_columns(df) if cols is None else existing(df, cols)
    ahead, behind = forward(keys, order), backward(keys, order)
    return df.withColumns(
        {c: F.coalesce(_nearest(F.col(c), ahead), _nearest(F.col(c), behind)) for c in cols}
    )


def between(c: str, leading: bool) -> Column:
    """Fill from the brackets ``_{c}_p`` and ``_{c}_n`` with their places ``_at``; a row's own place is ``_pos``."""
    before, after = F.col(f"_{c}_p"), F.col(f"_{c}_n")
    # positions count from either end; only ratios of their differences matter
    since, gap = F.col("_pos") - F.col(f"_{c}_p_at"), F.col(f"_{c}_n_at") - F.col(f"_{c}_p_at")
    # on a known row both brackets are the row itself, so test that first
    inner = F.when(F.col(c).isNotNull(), F.col(c)).when(
        before.isNotNull() & after.isNotNull(), guard(before + (after - before) / gap * since)
    )
    return F.coalesce(inner, before, after) if leading else F.coalesce(inner, before)


def interpolate(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    leading: bool = True,
    backward_first: bool = False,
) -> DataFrame:
    """Linear fill by row position; a trailing gap repeats the last value.

    A leading gap repeats the first value, or stays missing with
    ``leading=False``. All columns share one forward and one backward pass.
    ``backward_first`` only swaps the passes, to reuse the incoming sort order
    and to leave the rows in date order for the windows that follow.
    """
    if cols is None:
        df = measures_as_double(df)
    cols = double_columns(df) if cols is None else existing(df, cols)
    if not cols:
        return df
    ahead, behind = forward(keys, order), backward(keys, order)
    kept = df.columns

    passes = (behind, ahead) if backward_first else (ahead, behind)
    bracketed = df.withColumn("_pos", F.row_number().over(passes[0]))
    for window in passes:
        side = "p" if window is ahead else "n"
        nearest = {}
        # plain value and position columns: structs would cost twice as much here
        for c in cols:
            nearest[f"_{c}_{side}"] = _nearest(F.col(c), window)
            nearest[f"_{c}_{side}_at"] = _nearest(F.when(F.col(c).isNotNull(), F.col("_pos")), window)
        bracketed = bracketed.withColumns(nearest)

    return bracketed.select(*[between(c, leading).alias(c) if c in cols else F.col(f"`{c}`") for c in kept])


def blank_outliers(
    df: DataFrame, cols: Sequence[str], limit: float = config.OUTLIER_Z, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Values further than ``limit`` sample deviations from the series mean become NULL.

    The statistics ride on the station windows of the neighbouring steps, so
    they cost neither a second scan nor a join.
    """
    series = whole(keys)

    def blanked(c: str) -> Column:
        x = F.col(c)
        z = F.abs((x - F.avg(x).over(series)) / (F.stddev_samp(x).over(series) + config.EPSILON))
        return F.when(guard(z) > limit, F.lit(None)).otherwise(x)

    return df.withColumns({c: blanked(c) for c in existing(df, cols)})


def clean_series(
    df: DataFrame,
    outlier_cols: Sequence[str],
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    limit: float = config.OUTLIER_Z,
) -> DataFrame:
    """Fill gaps, blank outliers of the filled data, fill again.

    The statistics must come from the first fill, so the passes stay separate.
    """
    filled = interpolate(df, keys=keys, order=order)
    blanked = blank_outliers(filled, outlier_cols, limit, keys)
    return interpolate(blanked, keys=keys, order=order, backward_first=True)
