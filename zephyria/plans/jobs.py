"""Batch jobs from stored tables to stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from zephyria.operators import aggregates, spatial
from zephyria.operators.joins import attach_air
from zephyria.operators.series import KEYS
from zephyria.plans import clustering, daily, models
from zephyria.sources import schemas
from zephyria.sources.metrics_store import write_metrics
from zephyria.sources.tables import clustered, current, find, scan, scan_first, stored_bytes, write_clustered, write_table

#: Bytes of the raw tables for which the daily tables have one more bucket, the least and the most of them.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 1 << 22, 8, 1 << 11


def processed(root: str, name: str) -> str:
    return f"{root}/processed/{name}"


def raw(root: str, name: str) -> str:
    return f"{root}/raw/{name}"


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))


def preprocess(spark: SparkSession, root: str) -> DataFrame:
    """Raw weather and air to cleaned and merged tables.

    The merge reads the two cleaned tables back, so cleaning runs once and a
    lost executor only repeats the step it was in. The tables are written by the tasks that
    work them out: whoever reads them reads every year, so gathering them by year would only
    move them once more. They are clustered by station, as cleaning leaves them, so the merge
    and the windows over its result read them where they are. Nothing is written unless both
    inputs are there and have rows.
    """
    inputs = {n: find(spark, raw(root, n), s) for n, s in (("meteorological", schemas.WEATHER), ("aqi", schemas.AIR))}
    missing = [n for n, df in inputs.items() if df is None or df.isEmpty()]
    if missing:
        raise FileNotFoundError(f"no raw rows of {' and '.join(missing)} below {root}; stored tables are left as they are")
    weather, air = inputs.values()
    size = sum(stored_bytes(spark, raw(root, n)) for n in inputs)
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length()))  # shares or splits the parts of a shuffle
    write_clustered(daily.clean_weather(weather), processed(root, "met_processed"), *KEYS, buckets)
    write_clustered(daily.clean_air(air), processed(root, "aqi_processed"), *KEYS, buckets)
    merged = daily.merge_daily(*[clustered(spark, processed(root, n), *KEYS) for n in ("met_processed", "aqi_processed")])
    write_clustered(merged, processed(root, "merged_dataset"), *KEYS, buckets)
    return _stored(spark, processed(root, "merged_dataset"))


def features(spark: SparkSession, root: str) -> DataFrame:
    merged = clustered(spark, processed(root, "merged_dataset"), *KEYS)
    write_table(daily.engineer_features(merged), processed(root, "features_dataset"), partition_by=(), compression="zstd")
    return _stored(spark, processed(root, "features_dataset"))


def best_daily(spark: SparkSession, root: str) -> DataFrame | None:
    """The most processed daily table there is: merged before weather only."""
    stored = scan_first(
        spark, [(processed(root, n), None) for n in ("merged_dataset", "meteorological")], fmt="parquet"
    )
    if stored is not None:
        return stored
    merged_schema = T.StructType([*schemas.WEATHER.fields, *schemas.AIR.fields[2:]])
    return scan_first(
        spark,
        [(raw(root, "merged_dataset"), merged_schema), (raw(root, "meteorological"), schemas.WEATHER)],
    )


def risks(spark: SparkSession, root: str) -> DataFrame | None:
    """Score the best daily table, attaching raw air quality where it has none.

    Without any air table the column stays absent, so the scores use its default.
    """
    table = best_daily(spark, root)
    if table is None:
        return None
    if "aqi" not in table.columns:
        air = find(spark, raw(root, "aqi"), schemas.AIR)
        table = table if air is None else attach_air(table, air)
    write_table(table, processed(root, "health_risks"), then=daily.score_health)
    return _stored(spark, processed(root, "health_risks"))


def train(spark: SparkSession, root: str, only: Sequence[str] | None = None) -> DataFrame:
    """Train on the stored features, or on the merged table where there are none.

    Figures of the models that could be fitted are stored as one keyed document; the
    result also has a row for each that failed, with its error.
    """
    table = scan_first(spark, [(processed(root, n), None) for n in ("features_dataset", "merged_dataset")], fmt="parquet")
    if table is None:
        raise FileNotFoundError(f"neither features nor a merged table below {root}")
    trained = models.train_all(table, only)
    write_metrics(trained.where("error is null").drop("error"), f"{root}/models/metrics")
    return trained


# report -> (columns it needs, operator)
SEASONAL_REPORTS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {
    "seasonal_stats": (("season",), aggregates.seasonal_stats),
    "monthly_climatology": (("month",), aggregates.monthly_climatology),
    "annual_trend": (("year",), aggregates.annual_trend),
    "flood_risk_seasonal": (("season", "flood_risk"), aggregates.flood_shares),
    "aqi_seasonal_trend": (("year", "month", "aqi"), aggregates.aqi_by_month),
    "dengue_risk_seasonal": (("season", "dengue_risk"), aggregates.dengue_shares),
}


def seasonal(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The seasonal reports the stored table has the columns for.

    Every report reads only its own columns from the columnar table, which is
    cheaper than caching all of them.
    """
    table = best_daily(spark, root)
    if table is None:
        return {}
    have = set(table.columns)
    return {name: report(table) for name, (needs, report) in SEASONAL_REPORTS.items() if have.issuperset(needs)}


# report -> operator; nothing is fitted or read until a report is asked for
SPATIAL_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "clusters": clustering.cluster_wards,
    "hotspots": spatial.heat_hotspots,
    "flood_zones": spatial.flood_prone_wards,
}


def spatial_report(spark: SparkSession, root: str, name: str) -> DataFrame:
    return SPATIAL_REPORTS[name](scan(spark, raw(root, "ward"), schemas.WARD))
