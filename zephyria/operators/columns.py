"""Schema-adaptive projections, defaults and filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyria import config
from zephyria.functions import classes
from zephyria.functions.calendar import date_parts, season_flags, season_of
from zephyria.functions.numeric import clip


def existing(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """The requested columns the table has, in the requested order."""
    have = set(df.columns)
    return [c for c in columns if c in have]


def select_existing(df: DataFrame, columns: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *existing(df, columns))


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]


def measures_as_double(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every numeric column but keys and calendar parts as DOUBLE, so that all are cleaned alike."""
    fixed = {*keep, "station_id", "region_id", *calendar_columns()}
    measures = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in fixed]
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in measures if c not in double_columns(df)})


def fill_constants(df: DataFrame, values: Mapping[str, float] = config.FEED_DEFAULTS) -> DataFrame:
    return df.fillna({c: v for c, v in values.items() if c in df.columns})


def drop_missing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.na.drop(subset=existing(df, columns))


def calendar_columns() -> dict[str, Column]:
    date = F.col(config.DATE)
    return {**date_parts(date), "season": season_of(F.month(date))}


def add_calendar(df: DataFrame, columns: Sequence[str] = ("year", "month", "day", "doy", "season")) -> DataFrame:
    """Derive the named calendar columns from ``date``."""
    parts = calendar_columns()
    return df.withColumns({c: parts[c] for c in columns})


def add_season_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(season_flags(F.col("season")))


def year_range(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Inclusive year filter; an omitted bound means "from/to the end of the data"."""
    if lo is not None:
        df = df.where(F.col("year") >= lo)
    return df if hi is None else df.where(F.col("year") <= hi)


def year_cap(df: DataFrame, last_year: int) -> DataFrame:
    """Rows up to ``last_year``, or the whole table when there are none.

    The test is a pruned ``min(year)`` subquery, so the plan stays lazy.
    """
    earliest = df.agg(F.min("year").alias("y")).scalar()
    return df.where((F.col("year") <= last_year) | (F.coalesce(earliest, F.lit(last_year)) > last_year))


def split_at(df: DataFrame, cut: str | Date, column: str = config.DATE) -> tuple[DataFrame, DataFrame]:
    """(before, from) the cut-over date."""
    day = F.lit(cut).cast("date")
    return df.where(F.col(column) < day), df.where(F.col(column) >= day)


def health_inputs(df: DataFrame) -> dict[str, Column]:
    """Inputs of the risk scores; an absent *column* becomes a constant."""
    out: dict[str, Column] = {}
    for name, default in config.ABSENT_HEALTH_INPUTS.items():
        if name in df.columns:
            out[name] = F.col(name)
        elif isinstance(default, tuple):
            base, offset = default
            out[name] = out[base] + offset
        else:
            out[name] = F.lit(default)
    return out


#: Ranges that distinct labels are numbered in.
LABEL_RANGES = 256


def maps(df: DataFrame) -> set[str]:
    """Columns that cannot be hashed."""
    return {f.name for f in df.schema.fields if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()}


def encode_labels(df: DataFrame, column: str, target: str, fill: str | None = None) -> DataFrame:
    """Add the position of the label among the table's distinct labels, sorted, from 0.

    The distinct labels (merged map-side first) are dealt to ranges between the labels of
    least hash, numbered in each and joined back, so no buffer, row or task ever holds the
    whole vocabulary. The most frequent labels (``LABEL_RANGES`` at most) travel to the rows
    as one map, and their rows are spread by a salt, so the join sees no hot label.
    """
    label = F.col(column) if fill is None else F.coalesce(F.col(column), F.lit(fill))
    labels = df.select(label.alias("_label")).where(F.col("_label").isNotNull()).groupBy("_label").agg(F.count(F.lit(1)).alias("_rows"))
    edges = labels.orderBy(F.xxhash64("_label"), "_label").limit(LABEL_RANGES - 1).agg(F.sort_array(F.collect_list("_label"))).scalar()
    ranged = labels.withColumn("_edges", edges).select("_label", "_rows", F.size(F.filter("_edges", lambda e: e <= F.col("_label"))).alias("_range"))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("_range", "n"))).scalar()
    before = F.aggregate(F.filter("_sizes", lambda s: s["_range"] < F.col("_range")), F.lit(0).cast("long"), lambda n, s: n + s["n"])
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_label")) - 1
    codes = ranged.withColumn("_sizes", sizes).select("_label", "_rows", (place + before).cast("int").alias("_code"))
    hot = codes.orderBy(F.col("_rows").desc(), "_label").limit(LABEL_RANGES)
    hot = hot.agg(F.map_from_entries(F.collect_list(F.struct("_label", "_code")))).scalar()
    coded = df.withColumns({"_own": label, "_hot": hot}).withColumn("_hot", F.when(F.col("_own").isNotNull(), F.element_at("_hot", F.col("_own"))))
    # rows that need no partner (a hot label, or none) go anywhere, the others to their label
    salt = F.when(F.col("_hot").isNotNull() | F.col("_own").isNull(), F.xxhash64(*[c for c in coded.columns if c not in maps(df)]))
    salted = coded.withColumn("_to", F.struct(F.coalesce(salt.bitwiseOR(F.lit(1)), F.lit(0)).alias("salt"), F.col("_own").alias("label")))
    # one key: a constant of its own would leave the key, and the labels would be hot again
    known = codes.select(F.struct(F.lit(0).cast("long").alias("salt"), F.col("_label").alias("label")).alias("_to"), "_code")
    joined = salted.join(known.withColumnRenamed("_to", "_at"), F.col("_to") == F.col("_at"), "left")
    return joined.withColumn(target, F.coalesce("_hot", "_code")).drop("_own", "_hot", "_to", "_at", "_code")


def fill_absent_features(df: DataFrame) -> DataFrame:
    """Simple stand-ins for the model features that were never engineered."""
    have = set(df.columns)
    temp = F.col("temperature_mean")
    humidity = F.col("humidity") if "humidity" in have else F.lit(60.0)
    formulas: dict[str, tuple[str, Column]] = {
        "season_code": ("season", classes.season_code(F.col("season"))),
        "uhi_score": ("temperature_mean", clip(temp - config.RURAL_BASE_TEMP, lo=0)),
        "heat_index": ("temperature_mean", temp),
        "discomfort_index": (
            "temperature_mean",
            temp - F.lit(0.55) * (F.lit(1.0) - humidity / 100.0) * (temp - 14.5),
        ),
        "pollution_severity": ("aqi", clip(F.col("aqi") / 500.0, 0, 1)),
        "rainfall_anomaly": ("rainfall", F.lit(0.0)),
    }
    added = {c: expr for c, (needs, expr) in formulas.items() if c not in have and needs in have}
    for base in ("temp_class", "rain_class", "aqi", "flood_risk", "health_risk", "dengue_risk"):
        target = f"{base}_ordinal"
        if target in have:
            continue
        if base in have and isinstance(df.schema[base].dataType, T.StringType):
            df = encode_labels(df, base, target, fill="Low")
        else:
            added[target] = F.lit(0)
    return df.withColumns(added)


def add_risk_ordinals(df: DataFrame) -> DataFrame:
    """Integer codes of every risk or class label the table has."""
    return df.withColumns(
        {f"{kind}_ordinal": classes.risk_ordinal(kind, F.col(kind)) for kind in existing(df, config.RISK_CODES)}
    )

