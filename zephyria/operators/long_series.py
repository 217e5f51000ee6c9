"""Series operators for one series that is longer than a task should hold.

The operators of ``gaps`` and ``windows`` keep a whole series in one window group. Here a
series is dealt to calendar buckets; each bucket tells a few figures (rows, first and last
known value, maximum, moments), a prefix pass over that narrow table hands every bucket
what lies before and after it, and rows meet it by series and bucket. What needs
neighbouring rows gets them by position: blocks of equally many rows, each with a halo of
the rows before it, so neither gaps in the calendar nor dense months matter.

Results equal those of the window forms. ``bucket`` is any column that does not decrease
along the series; ``order`` is not null and unique within a series. Series keys may be
null. The prefix pass holds one row a bucket of a series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyria import config
from zephyria.functions.numeric import guard, rnd
from zephyria.operators import windows
from zephyria.operators.columns import double_columns, drop_missing, existing, measures_as_double
from zephyria.operators.gaps import between
from zephyria.operators.series import KEYS, ORDER, backward, forward, so_far

#: Rows of a series in one block, besides its halo.
BLOCK_ROWS = 65536
#: Series and bucket as one struct: it joins and groups null keys too, and all steps share one layout.
AT = ("_at",)


def month(order: str = ORDER) -> Column:
    return F.date_trunc("month", F.col(order))


def _dealt(df: DataFrame, keys: Sequence[str], order: str, bucket: Column | None) -> DataFrame:
    bucket = month(order) if bucket is None else bucket
    return df.withColumn("_at", F.struct(*keys, bucket.alias("_bucket")))


def _placed(df: DataFrame, keys: Sequence[str], order: str, bucket: Column | None) -> DataFrame:
    return _dealt(df, keys, order, bucket).withColumn("_here", F.row_number().over(forward(AT, order)))


def _by_series(told: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The buckets' figures with series and bucket as columns of their own.

    Windows over fields of ``_at`` would each make a column anew, and Spark shuffle by each.
    """
    return told.withColumns({**{f"_key{i}": F.col("_at").getField(k) for i, k in enumerate(keys)}, "_nth": F.col("_at._bucket")})


def _series(keys: Sequence[str]) -> list[str]:
    return [f"_key{i}" for i in range(len(keys))]


def _earlier(keys: Sequence[str]):
    return Window.partitionBy(*_series(keys)).orderBy(F.col("_nth").asc()).rowsBetween(Window.unboundedPreceding, -1)


def _later(keys: Sequence[str]):
    return Window.partitionBy(*_series(keys)).orderBy(F.col("_nth").desc()).rowsBetween(Window.unboundedPreceding, -1)


def with_positions(
    df: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, bucket: Column | None = None
) -> DataFrame:
    """Add ``_pos``, a row's place in its series from 1, and ``_n``, the length of the series."""
    totals = _dealt(df, keys, order, bucket).groupBy("_at").agg(F.count(F.lit(1)).alias("_rows"))
    sums = _by_series(totals, keys).select(
        "_at",
        F.coalesce(F.sum("_rows").over(_earlier(keys)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*_series(keys))).alias("_n"),
    )
    rows = _placed(df, keys, order, bucket).join(sums, "_at")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_here")).alias("_pos"), "_n")


def in_blocks(
    df: DataFrame,
    before: int,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    bucket: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows with ``_block``, the series and block they serve in; the last ``before`` rows of a
    block serve in the next one too, marked ``_halo``."""
    size = max(block_rows, before, 1)
    rows = with_positions(df, keys, order, bucket)
    at = F.col("_pos") - 1
    home = F.floor(at / size)
    serves = F.when((at % size >= size - before) & (F.floor((F.col("_n") - 1) / size) > home), F.array(home, home + 1))
    rows = rows.withColumn("_home", home).withColumn("_serves", F.explode(F.coalesce(serves, F.array(home))))
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.struct(*keys, "_serves").alias("_block"),
        (F.col("_serves") != F.col("_home")).alias("_halo"),
    )


def _own(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_block", "_halo")


def _bracketed(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: str, bucket: Column | None
) -> DataFrame:
    """Nearest known values on either side with their places, carried over buckets."""
    rows = _placed(df, keys, order, bucket)
    figures = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        place = F.when(F.col(c).isNotNull(), F.col("_here"))
        figures += [
            F.min_by(c, place).alias(f"_{c}_first"),
            F.min(place).alias(f"_{c}_first_at"),
            F.max_by(c, place).alias(f"_{c}_last"),
            F.max(place).alias(f"_{c}_last_at"),
        ]
    told = _by_series(rows.groupBy("_at").agg(*figures), keys)
    told = told.withColumn("_before", F.coalesce(F.sum("_rows").over(_earlier(keys)), F.lit(0)))
    carried = []
    for c in cols:
        for name, side, w in (("last", "p", _earlier(keys)), ("first", "n", _later(keys))):
            carried.append(F.last(f"_{c}_{name}", ignorenulls=True).over(w).alias(f"_{c}_{side}_far"))
            far_at = F.col("_before") + F.col(f"_{c}_{name}_at")
            carried.append(F.last(far_at, ignorenulls=True).over(w).alias(f"_{c}_{side}_far_at"))
    rows = rows.join(told.select("_at", "_before", *carried), "_at")
    rows = rows.withColumn("_pos", F.col("_before") + F.col("_here"))
    for side, w in (("p", so_far(forward(AT, order))), ("n", so_far(backward(AT, order)))):
        near = {}
        for c in cols:
            place = F.when(F.col(c).isNotNull(), F.col("_pos"))
            near[f"_{c}_{side}"] = F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_{c}_{side}_far"))
            near[f"_{c}_{side}_at"] = F.coalesce(F.last(place, ignorenulls=True).over(w), F.col(f"_{c}_{side}_far_at"))
        rows = rows.withColumns(near)
    return rows


def fill_nearest(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    bucket: Column | None = None,
    ahead: bool = True,
) -> DataFrame:
    """Carry the last value forward, then the first one back; with ``ahead=False`` only back."""
    if cols is None:
        df = measures_as_double(df)
    cols = double_columns(df) if cols is None else existing(df, cols)
    rows = _bracketed(df, cols, keys, order, bucket)

    def filled(c: str) -> Column:
        return F.coalesce(F.col(f"_{c}_p"), F.col(f"_{c}_n")) if ahead else F.col(f"_{c}_n")

    return rows.select(*[filled(c).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def interpolate(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    bucket: Column | None = None,
    leading: bool = True,
) -> DataFrame:
    """Linear fill by row position, as ``gaps.interpolate``."""
    if cols is None:
        df = measures_as_double(df)
    cols = double_columns(df) if cols is None else existing(df, cols)
    rows = _bracketed(df, cols, keys, order, bucket)
    return rows.select(*[between(c, leading).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def blank_outliers(
    df: DataFrame,
    cols: Sequence[str],
    limit: float = config.OUTLIER_Z,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    bucket: Column | None = None,
) -> DataFrame:
    """Values further than ``limit`` sample deviations from the series mean become NULL.

    Moments are taken a bucket, merged to those of the series, and met by bucket.
    """
    cols = existing(df, cols)
    rows = _dealt(df, keys, order, bucket)
    figures = []
    for c in cols:
        figures += [F.count(c).alias(f"_{c}_k"), F.avg(c).alias(f"_{c}_m"), (F.var_pop(c) * F.count(c)).alias(f"_{c}_q")]
    told = _by_series(rows.groupBy("_at").agg(*(figures or [F.count(F.lit(1)).alias("_rows")])), keys)
    series = Window.partitionBy(*_series(keys))
    merged, spread = {}, {}
    for c in cols:
        k, m = F.col(f"_{c}_k"), F.col(f"_{c}_m")
        merged |= {f"_{c}_all": F.sum(k).over(series), f"_{c}_mean": F.try_divide(F.sum(k * m).over(series), F.sum(k).over(series))}
        total = F.sum(F.col(f"_{c}_q") + k * (m - F.col(f"_{c}_mean")) ** 2).over(series)
        spread[f"_{c}_sd"] = F.sqrt(F.when(F.col(f"_{c}_all") > 1, total / (F.col(f"_{c}_all") - 1)))
    told = told.withColumns(merged).withColumns(spread)
    met = rows.join(told.select("_at", *[f"_{c}_{f}" for c in cols for f in ("mean", "sd")]), "_at")

    def blanked(c: str) -> Column:
        z = F.abs((F.col(c) - F.col(f"_{c}_mean")) / (F.col(f"_{c}_sd") + config.EPSILON))
        return F.when(guard(z) > limit, F.lit(None)).otherwise(F.col(c))

    return met.select(*[blanked(c).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def clean_series(
    df: DataFrame,
    outlier_cols: Sequence[str],
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    limit: float = config.OUTLIER_Z,
    bucket: Column | None = None,
) -> DataFrame:
    """Fill gaps, blank outliers of the filled data, fill again."""
    filled = interpolate(df, keys=keys, order=order, bucket=bucket)
    return interpolate(blank_outliers(filled, outlier_cols, limit, keys, order, bucket), keys=keys, order=order, bucket=bucket)


def rolling_mean(
    df: DataFrame,
    outputs: Mapping[str, tuple[str, int, int]],
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    bucket: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``{new: (column, rows, digits)}`` trailing means; missing values are skipped."""
    rows = in_blocks(df, max(n for _, n, _ in outputs.values()) - 1, keys, order, bucket, block_rows)
    return _own(windows.rolling_mean(rows, outputs, ("_block",), order))


def rolling_anomaly(
    df: DataFrame,
    column: str,
    out: str,
    rows: int = 30,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    bucket: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(x - mean) / sd over the trailing rows, as ``windows.rolling_anomaly``."""
    dealt = in_blocks(df, rows - 1, keys, order, bucket, block_rows)
    return _own(windows.rolling_anomaly(dealt, column, out, rows, ("_block",), order))


def lag_filled(
    df: DataFrame,
    outputs: Mapping[str, tuple[str, int]],
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    bucket: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``{new: (column, k)}`` lags; a missing lag takes the next one available."""
    rows = in_blocks(df, max(k for _, k in outputs.values()), keys, order, bucket, block_rows)
    ahead = forward(("_block",), order)
    lagged = _own(rows.withColumns({new: F.lag(c, k).over(ahead) for new, (c, k) in outputs.items()}))
    return fill_nearest(lagged, list(outputs), keys, order, bucket, ahead=False)


def sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    length: int = config.SEQUENCE_LENGTH,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    bucket: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``length`` preceding feature rows with the current row as target.

    A halo row has fewer than ``length`` rows before it in its block, so none becomes a target twice.
    """
    whole_rows = drop_missing(df, [*existing(df, features), target])
    rows = in_blocks(whole_rows, length, keys, order, bucket, block_rows)
    return windows.sequences(rows, features, target, length, (*keys, "_block"), order).drop("_block")


def loss_since_first(
    df: DataFrame, column: str, out: str, keys: Sequence[str], order: str, bucket: Column | None = None
) -> DataFrame:
    """Percentage lost against the first row of the series."""
    rows = _dealt(df, keys, order, bucket)
    told = _by_series(rows.groupBy("_at").agg(F.min_by(F.struct(F.col(column).alias("x")), F.col(order)).alias("_row")), keys)
    start = so_far(Window.partitionBy(*_series(keys)).orderBy(F.col("_nth").asc()))
    met = rows.join(told.select("_at", F.first("_row").over(start).getField("x").alias("_first")), "_at")
    first = F.col("_first")
    return met.withColumn(out, rnd(F.try_divide(first - F.col(column), first) * 100.0, 2)).drop("_at", "_first")


def running_max(
    df: DataFrame, column: str, out: str, keys: Sequence[str], order: str, bucket: Column | None = None
) -> DataFrame:
    """The largest value so far; NULL where the row's own value is."""
    rows = _dealt(df, keys, order, bucket)
    told = _by_series(rows.groupBy("_at").agg(F.max(column).alias("_peak")), keys)
    met = rows.join(told.select("_at", F.max("_peak").over(_earlier(keys)).alias("_far")), "_at")
    peak = F.greatest(F.max(column).over(so_far(forward(AT, order))), F.col("_far"))
    return met.withColumn(out, F.when(F.col(column).isNotNull(), peak)).drop("_at", "_far")


def temporal_split(
    df: DataFrame,
    train: float = config.TRAIN_FRACTION,
    validation: float = config.VALIDATION_FRACTION,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    bucket: Column | None = None,
) -> DataFrame:
    """Label each row ``train``/``validation``/``test`` by its place in the series."""
    rows = with_positions(df, keys, order, bucket)
    label = windows.split_label(F.col("_pos") - 1, F.col("_n"), train, validation)
    return rows.withColumn("split", label).drop("_pos", "_n")
