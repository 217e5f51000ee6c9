"""Rolling, lag, difference, running and sequence operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyria import config
from zephyria.functions.numeric import guard, rnd
from zephyria.operators.columns import drop_missing, existing
from zephyria.operators.series import KEYS, ORDER, backward, forward, so_far, trailing, whole


def rolling_mean(
    df: DataFrame,
    outputs: Mapping[str, tuple[str, int, int]],
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
) -> DataFrame:
    """``{new: (column, rows, digits)}`` trailing means; missing values are skipped."""
    return df.withColumns(
        {new: rnd(F.avg(c).over(trailing(n, keys, order)), d) for new, (c, n, d) in outputs.items()}
    )


def rolling_anomaly(
    df: DataFrame, column: str, out: str, rows: int = 30, keys: Sequence[str] = KEYS, order: str = ORDER
) -> DataFrame:
    """(x - mean) / sd over the trailing rows.

    One value alone has a deviation of 1 by convention, so its anomaly is 0. A
    constant window has no anomaly; it is recognised by min = max, because a
    computed deviation of a constant need not be exactly zero.
    """
    frame = trailing(rows, keys, order)
    x = F.col(column)
    off = x - F.avg(x).over(frame)
    flat = F.min(x).over(frame) == F.max(x).over(frame)
    z = (
        F.when(F.count(x).over(frame) == 1, off)
        .when(flat, F.lit(None))
        .otherwise(F.try_divide(off, F.stddev_samp(x).over(frame)))
    )
    return df.withColumn(out, rnd(z, 3))


def lag_filled(
    df: DataFrame, outputs: Mapping[str, tuple[str, int]], keys: Sequence[str] = KEYS, order: str = ORDER
) -> DataFrame:
    """``{new: (column, k)}`` lags; a missing lag takes the next one available."""
    ahead, behind = forward(keys, order), so_far(backward(keys, order))
    lagged = df.withColumns({new: F.lag(c, k).over(ahead) for new, (c, k) in outputs.items()})
    return lagged.withColumns({new: F.last(new, ignorenulls=True).over(behind) for new in outputs})


def difference(
    df: DataFrame, outputs: Mapping[str, tuple[str, int]], keys: Sequence[str], order: str
) -> DataFrame:
    """``{new: (column, digits)}`` row-to-row changes, 0 where there is none."""
    w = forward(keys, order)
    return df.withColumns(
        {new: rnd(F.coalesce(F.col(c) - F.lag(c, 1).over(w), F.lit(0.0)), d) for new, (c, d) in outputs.items()}
    )


def loss_since_first(df: DataFrame, column: str, out: str, keys: Sequence[str], order: str) -> DataFrame:
    """Percentage lost against the first row of the series."""
    first = F.first(column).over(so_far(forward(keys, order)))
    return df.withColumn(out, rnd(F.try_divide(first - F.col(column), first) * 100.0, 2))


def running_max(df: DataFrame, column: str, out: str, keys: Sequence[str], order: str) -> DataFrame:
    peak = F.max(column).over(so_far(forward(keys, order)))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), peak))


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row per key by ``order``.

    A ``min_by`` aggregate merges map-side, so a hot key costs one row per task
    instead of one sorted group.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    length: int = config.SEQUENCE_LENGTH,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
) -> DataFrame:
    """The ``length`` preceding feature rows with the current row as target.

    Rows with a missing feature are dropped first and positions count after
    that. ``steps`` is ordered oldest first. A series of n rows gives
    n - length sequences.
    """
    features = existing(df, features)
    rows = drop_missing(df, [*features, target])
    frame = forward(keys, order).rowsBetween(-length, -1)
    step = F.struct(*[F.col(c).alias(c) for c in features])
    return (
        rows.select(
            *keys,
            order,
            F.col(target).alias("target"),
            F.collect_list(step).over(frame).alias("steps"),
        )
        .where(F.size("steps") == length)
    )


def flatten_steps(steps: Column, features: Sequence[str]) -> Column:
    """One flat array: step 1's features, then step 2's, and so on."""
    return F.flatten(F.transform(steps, lambda s: F.array(*[s[f] for f in features])))


def split_label(
    pos: Column, n: Column, train: float = config.TRAIN_FRACTION, validation: float = config.VALIDATION_FRACTION
) -> Column:
    """``train``/``validation``/``test`` for row ``pos`` (from 0) of the ``n`` of its series."""
    cut = F.when(pos < F.floor(guard(n * train)), "train").when(
        pos < F.floor(guard(n * (train + validation))), "validation"
    )
    return cut.otherwise("test")


def temporal_split(
    df: DataFrame,
    train: float = config.TRAIN_FRACTION,
    validation: float = config.VALIDATION_FRACTION,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
) -> DataFrame:
    """Label each row ``train``/``validation``/``test`` by its place in the series."""
    n = F.count(F.lit(1)).over(whole(keys))
    pos = F.row_number().over(forward(keys, order)) - 1
    return df.withColumn("split", split_label(pos, n, train, validation))
