"""Forecasters and classifiers grown on the feature table by ``forests``."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyria import config
from zephyria.functions.numeric import clip
from zephyria.operators import metrics
from zephyria.operators.columns import existing, fill_absent_features
from zephyria.operators.ordering import last_rows_per_key
from zephyria.operators.series import KEYS, ORDER, forward, whole
from zephyria.operators.tree_growth import Rules
from zephyria.operators.windows import split_label
from zephyria.plans import forests
from zephyria.session import scratch_path
from zephyria.sources import schemas

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Forecast:
    """A one-step-ahead regression on the preceding rows of a series."""

    task: str
    target: str
    features: tuple[str, ...]
    test_on_validation: bool = False  # test on everything after the training part
    floor: float | None = None
    depth: int = 60  # as deep as the rows of a leaf allow


@dataclass(frozen=True)
class Classification:
    task: str
    target: str
    features: tuple[str, ...]
    trees: int
    depth: int
    boosted: bool = False


FORECASTS = {
    "forecast_temp": Forecast(
        "Temperature Forecasting",
        "temperature_mean",
        ("temperature_mean", "humidity", "pressure", "wind_speed"),
        test_on_validation=True,
    ),
    "forecast_aqi": Forecast("AQI Forecasting", "aqi", ("aqi", "pm25", "pm10", "temperature_mean", "humidity")),
    "forecast_rain": Forecast(
        "Rainfall Prediction", "rainfall", ("rainfall", "temperature_mean", "humidity", "pressure"), floor=0.0
    ),
    "forecast_temp_ctx": Forecast(
        "Temperature Forecasting", "temperature_mean", ("temperature_mean", "humidity", "wind_speed", "pressure")
    ),
}
CLASSIFIERS = {
    "heat_zone_rf": Classification(
        "Heat-Zone Classification",
        "temp_class_ordinal",
        ("temperature_mean", "humidity", "uhi_score", "heat_index", "season_code", "doy", "wind_speed"),
        trees=150,
        depth=12,
    ),
    "flood_gbt": Classification(
        "Flood-Risk Classification",
        "flood_risk_ordinal",
        ("rainfall", "humidity", "temperature_mean", "wind_speed", "rainfall_anomaly", "season_code"),
        trees=150,
        depth=6,
        boosted=True,
    ),
    "health_rf": Classification(
        "Human Health Risk Classification",
        "health_risk_ordinal",
        (
            "temperature_mean",
            "aqi",
            "humidity",
            "uhi_score",
            "heat_index",
            "discomfort_index",
            "pollution_severity",
            "season_code",
        ),
        trees=200,
        depth=10,
    ),
}
LEARNING_RATE = 0.1
#: Ridge on the leaf steps of boosting, and cut points plus one of a column.
BOOST_RIDGE = 1.0
FORECAST_BINS, CLASS_BINS = 32, 64


def forecast_rows(df: DataFrame, spec: Forecast) -> DataFrame:
    """(series, pos, split, keys, label, hash, features): the place of every complete row in its series.

    The first rows of a series only fill the windows of later ones; they have no split.
    """
    features = existing(df, spec.features)
    needed = list(dict.fromkeys([*features, spec.target]))
    narrow = df.select(*KEYS, ORDER, *needed).na.drop(subset=needed)
    pos = F.row_number().over(forward()) - 1
    placed = narrow.withColumns({"pos": pos, "n": F.count(F.lit(1)).over(whole())})
    length = config.SEQUENCE_LENGTH
    split = F.when(F.col("pos") >= length, split_label(F.col("pos") - length, F.col("n") - length))
    return placed.select(
        *[F.col(k) for k in (*KEYS, ORDER)],
        F.struct(*KEYS).alias("series"),
        "pos",
        split.alias("split"),
        F.col(spec.target).cast("double").alias("label"),
        F.xxhash64(*KEYS, ORDER).alias("hash"),
        *[F.col(c).cast("double").alias(f"feature_{c}") for c in features],
    )


def _written(rows: DataFrame) -> DataFrame:
    """The rows of a model, written out: labels, cut points and blocks each read them."""
    path = scratch_path(rows.sparkSession, "model-rows")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run_forecast(
    df: DataFrame, spec: Forecast, seed: int = config.SEED, trees: int | None = None, known: dict | None = None
) -> DataFrame:
    """(station, date, actual, predicted) of the test rows.

    Trees see order only and leaves hold means, so values are used in their own units.
    ``known`` keeps forests: specs that learn the same from the same columns share one.
    """
    features = sorted(existing(df, spec.features))
    names = [f"feature_{c}" for c in features]
    tested = F.col("split") != "train" if spec.test_on_validation else F.col("split") == "test"
    part = F.when(F.col("split") == "train", forests.TRAIN).when(tested, forests.TEST).otherwise(forests.SKIP)
    rows = _written(forecast_rows(df, spec).withColumn("part", part).withColumn("hash", F.xxhash64("hash", F.lit(seed))))
    cuts = forests.cut_points(rows, names, FORECAST_BINS)
    length = config.SEQUENCE_LENGTH
    blocks = forests.stored_blocks(rows.drop("split"), (*KEYS, ORDER), names, cuts, length)
    try:
        weight = forests.training_rows(blocks)
        steps = [(lag, c) for lag in range(length, 0, -1) for c in range(len(names))]
        lags, columns = zip(*steps)
        rules = Rules(lags, columns, FORECAST_BINS, depth=spec.depth, least=forests.leaf_weight(weight))
        key = (spec.target, tuple(names), rules, seed)
        known = {} if known is None else known
        if key not in known:
            known[key] = forests.grow_forest(blocks, rules, len(names), trees or config.FORECAST_TREES, weight)
    finally:
        blocks.unpersist()
    out = forests.predicted(blocks, known[key], (*KEYS, ORDER))
    if spec.floor is not None:
        out = out.withColumns({c: clip(F.col(c), lo=spec.floor) for c in ("actual", "predicted")})
    return out


def is_holdout(keys: Sequence[str] = (*KEYS, ORDER), percent: int = config.HOLDOUT_PERCENT, seed: int = config.SEED):
    """A row's place in the hold-out depends on its key only: the first 32 bits of the
    key's MD5, modulo 100.

    Unlike a random split this does not change with the partitioning, so a
    recomputed partition can never leak test rows into training.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return bits % 100 < percent


def class_labels(rows: DataFrame) -> np.ndarray:
    """The labels that occur, rising; more than ``MOST_CLASSES`` are no classes."""
    found = [r[0] for r in rows.select("label").distinct().limit(metrics.MOST_CLASSES + 1).collect()]
    if len(found) > metrics.MOST_CLASSES:
        raise ValueError(f"a classifier takes at most {metrics.MOST_CLASSES} labels")
    return np.array(sorted(found), np.float64)


def run_classifier(df: DataFrame, spec: Classification, seed: int = config.SEED) -> DataFrame:
    """(station, date, actual, predicted) of the hold-out rows."""
    features = existing(df, spec.features)
    names = [f"feature_{c}" for c in features]
    rows = df.select(
        *KEYS,
        ORDER,
        F.col(spec.target).cast("double").alias("label"),
        F.xxhash64(*KEYS, ORDER, F.lit(seed)).alias("hash"),
        F.when(is_holdout(), forests.TEST).otherwise(forests.TRAIN).alias("part"),
        *[F.col(c).cast("double").alias(f"feature_{c}") for c in features],
    ).na.drop(subset=["label", *names])
    rows = _written(rows)
    labels = class_labels(rows)
    cuts = forests.cut_points(rows, names, CLASS_BINS)
    codes = F.create_map(*[F.lit(x) for i, v in enumerate(labels.tolist()) for x in (v, float(i))])
    coded = rows.withColumn("label", codes[F.col("label")]) if len(labels) else rows
    blocks = forests.stored_blocks(coded, (*KEYS, ORDER), names, cuts, 0)
    rules = Rules((0,) * len(names), tuple(range(len(names))), CLASS_BINS, targets=max(1, len(labels)), counted=True)
    try:
        if spec.boosted:
            rules = replace(rules, ridge=BOOST_RIDGE, targets=1, counted=False)
            rounds = forests.boosted(blocks, rules, len(names), len(labels), spec.trees, spec.depth, LEARNING_RATE)
            out = forests.boosted_classes(blocks, rounds, rules, len(names), labels, (*KEYS, ORDER))
        else:
            weight = forests.training_rows(blocks)
            tried = max(1, math.isqrt(len(names)))
            rules = replace(rules, tried=tried, depth=spec.depth, least=forests.leaf_weight(weight))
            forest = forests.grow_forest(blocks, rules, len(names), spec.trees, weight)
            out = forests.predicted(blocks, forest, (*KEYS, ORDER), labels)
    finally:
        blocks.unpersist()
    return out.select(*KEYS, ORDER, F.col("actual").cast("int").alias("actual"), F.col("predicted").cast("int").alias("predicted"))


def _metric_row(df: DataFrame, model: str, task: str) -> DataFrame:
    present = [f"{c}" for c in df.columns]
    empty = [f for f in schemas.METRIC.fields if f.name not in (*present, "model", "task")]
    return df.select(
        F.lit(model).alias("model"),
        F.lit(task).alias("task"),
        *present,
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in empty],
    ).select(*schemas.METRIC.fieldNames())


def forecast_metrics(predictions: DataFrame, model: str, spec: Forecast) -> DataFrame:
    return _metric_row(metrics.regression_metrics(predictions), model, spec.task)


def classifier_metrics(predictions: DataFrame, model: str, spec: Classification) -> DataFrame:
    predictions = predictions.persist(StorageLevel.MEMORY_AND_DISK)  # read by the scores and by the matrix
    scored = metrics.classification_metrics(predictions)
    matrix = metrics.matrix_array(predictions).scalar()
    return _metric_row(scored.withColumn("ConfusionMatrix", matrix), model, spec.task)


def train_all(df: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """One metrics row per model, with ``error`` where a fit failed.

    The feature table is persisted once (spilling to disk) for all the fits. Boosting is
    a long row of short jobs, so it runs beside the others, in a fair pool of its own
    where the scheduler has pools. Forecasts that share a forest run one after another.
    """
    spark: SparkSession = df.sparkSession
    table = fill_absent_features(df).persist(StorageLevel.MEMORY_AND_DISK)
    grown: dict = {}
    jobs: dict[str, Callable[[], DataFrame]] = {
        name: lambda n=name, s=spec: classifier_metrics(run_classifier(table, s), n, s)
        for name, spec in CLASSIFIERS.items()
    } | {
        name: lambda n=name, s=spec: forecast_metrics(run_forecast(table, s, known=grown), n, s)
        for name, spec in FORECASTS.items()
    }
    tasks = {n: s.task for n, s in {**FORECASTS, **CLASSIFIERS}.items()}

    def attempt(name: str) -> list[tuple]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return [(*row, None) for row in jobs[name]().collect()]  # one row of figures per model
        except Exception as err:  # one failing model must not stop the others, and must not go unseen
            log.exception("model %s failed", name)
            empty = [None] * (len(schemas.METRIC.fields) - 2)
            return [(name, tasks[name], *empty, f"{type(err).__name__}: {err}"[:500])]

    wanted = [n for n in jobs if only is None or n in only]
    series = [[n] for n in wanted if n in CLASSIFIERS and CLASSIFIERS[n].boosted]
    series.append([n for n in wanted if [n] not in series])
    try:
        table.count()  # filled once, before several fits want it
        with ThreadPool(len(series)) as pool:
            done = pool.map(inheritable_thread_target(spark)(lambda names: [row for n in names for row in attempt(n)]), series, chunksize=1)
    finally:
        table.unpersist()
    schema = T.StructType([*schemas.METRIC.fields, T.StructField("error", T.StringType())])
    order = list(tasks)
    rows = sorted((row for rows in done for row in rows), key=lambda row: order.index(row[0]))
    return spark.createDataFrame(rows, schema)


def forecast_compare(predictions: DataFrame, rows: int = 30) -> DataFrame:
    """The last test days of every series, actual against predicted."""
    return last_rows_per_key(predictions, rows)
