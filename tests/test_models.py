import math
from dataclasses import replace

import numpy as np
import pytest
from frames import series
from pyspark.sql import functions as F

from zephyria.operators import windows
from zephyria.operators.metrics import regression_metrics
from zephyria.plans import clustering, models
from zephyria.plans.models import Classification, Forecast
from zephyria.sources import schemas


@pytest.fixture(scope="module")
def waves(spark):
    """Two stations with a noisy yearly wave."""
    rng = np.random.default_rng(5)
    n = 400
    parts = []
    for k in (1, 2):
        t = [20 + 8 * math.sin(2 * math.pi * i / 60 + k) + float(rng.normal(0, 0.3)) for i in range(n)]
        parts.append(
            series(spark, {"temperature_mean": t, "humidity": [60 - v for v in t], "rainfall": [max(0.0, v - 20) for v in t]}, k)
        )
    return parts[0].union(parts[1]).cache()


@pytest.fixture
def few_trees(monkeypatch):
    monkeypatch.setattr(models.config, "FORECAST_TREES", 5)
    monkeypatch.setattr(models, "FORECASTS", {n: replace(s, depth=5) for n, s in models.FORECASTS.items()})


SPEC = Forecast("t", "temperature_mean", ("temperature_mean", "humidity", "absent"), depth=5)


def test_forecast_beats_the_mean(waves, few_trees):
    out = models.run_forecast(waves, SPEC)
    assert regression_metrics(out).collect()[0]["R2"] > 0.8
    lo, hi = waves.agg(F.min("temperature_mean"), F.max("temperature_mean")).collect()[0]
    got = out.agg(F.min("actual"), F.max("actual")).collect()[0]
    assert lo - 1e-6 <= got[0] and got[1] <= hi + 1e-6  # back in original units


def test_no_test_row_precedes_a_training_row(waves):
    rows = models.forecast_rows(waves, SPEC).where("split is not null")
    edges = rows.groupBy("station_id").agg(
        F.max(F.when(F.col("split") == "train", F.col("date"))).alias("last_train"),
        F.min(F.when(F.col("split") == "test", F.col("date"))).alias("first_test"),
        F.count("*").alias("n"),
    )
    for r in edges.collect():
        assert r["last_train"] < r["first_test"] and r["n"] == 370


def test_rain_forecast_is_never_negative(waves, few_trees):
    spec = Forecast("r", "rainfall", ("rainfall", "temperature_mean"), floor=0.0, depth=5)
    assert models.run_forecast(waves, spec).agg(F.min("predicted")).collect()[0][0] >= 0


@pytest.mark.parametrize("boosted", [False, True])
def test_classifier_learns_a_threshold_rule(waves, boosted):
    label = F.when(F.col("temperature_mean") > 24, 2).when(F.col("temperature_mean") > 16, 1).otherwise(0)
    spec = Classification("c", "label_code", ("temperature_mean", "humidity"), trees=4, depth=4, boosted=boosted)
    out = models.run_classifier(waves.withColumn("label_code", label), spec)
    row = models.classifier_metrics(out, "m", spec).collect()[0]
    assert row["Accuracy"] > 0.95 and sum(map(sum, row["ConfusionMatrix"])) == out.count()


def test_holdout_is_stable_under_repartitioning(waves):
    def held(df):
        return {(r["station_id"], r["date"]) for r in df.where(models.is_holdout()).collect()}

    base = held(waves)
    assert base == held(waves.repartition(7)) and 0.15 < len(base) / waves.count() < 0.35


def test_train_all_survives_a_failing_model(waves, few_trees):
    """Without air-quality columns the AQI model cannot run: its row says so, the other's has figures."""
    daily = waves.withColumns({"season": F.lit("Summer"), "wind_speed": F.lit(1.0), "pressure": F.lit(1000.0)})
    out = models.train_all(daily, only=["forecast_aqi", "forecast_temp_ctx"])
    assert out.schema.fieldNames() == [*schemas.METRIC.fieldNames(), "error"]
    rows = {r["model"]: r for r in out.collect()}
    assert rows["forecast_temp_ctx"]["error"] is None and rows["forecast_temp_ctx"]["RMSE"] > 0
    assert rows["forecast_aqi"]["error"] and rows["forecast_aqi"]["RMSE"] is None


def test_all_seven_models_fit(spark, monkeypatch):
    """Every model of the catalogue on the small tables, with fewer trees of full depth."""
    from zephyria.catalog.model_queries import features

    monkeypatch.setattr(models.config, "FORECAST_TREES", 2)
    monkeypatch.setattr(models, "CLASSIFIERS", {n: replace(s, trees=3) for n, s in models.CLASSIFIERS.items()})
    rows = {r["model"]: r for r in models.train_all(features(spark, "/root/testdata/sf0.001")).collect()}
    assert set(rows) == {*models.FORECASTS, *models.CLASSIFIERS} and not any(r["error"] for r in rows.values())
    assert all(rows[n]["RMSE"] > 0 for n in models.FORECASTS) and all(rows[n]["Accuracy"] > 0.85 for n in models.CLASSIFIERS)


def test_flat_vector_order(spark):
    df = series(spark, {"a": [float(i) for i in range(31)], "b": [float(-i) for i in range(31)]})
    steps = windows.sequences(df, ["a", "b"], "a")
    flat = steps.select(windows.flatten_steps(F.col("steps"), ["a", "b"])).collect()[0][0]
    assert flat == [v for i in range(30) for v in (float(i), float(-i))]


def test_clusters_cover_all_wards_and_beat_single_starts(spark):
    rng = np.random.default_rng(2)
    rows = [(f"w{i}", *[float(v) for v in rng.normal(10 * (i % 5), 0.5, 5)]) for i in range(40)]
    cols = ("avg_temp", "annual_rainfall", "avg_aqi", "ndvi", "buildup_pct")
    wards = spark.createDataFrame(rows, "ward string, " + ", ".join(f"{c} double" for c in cols))
    out = clustering.cluster_wards(wards).collect()
    assert len(out) == 40 and {r["cluster"] for r in out} == set(range(5))
    planted = {}
    for r in out:
        planted.setdefault(int(r["ward"][1:]) % 5, set()).add(r["cluster"])
    assert all(len(v) == 1 for v in planted.values())


def test_all_starts_advance_in_the_same_jobs(spark):
    """As cheap as the best of single starts; rows of equal profile never part."""
    rng = np.random.default_rng(4)
    cols = [c for c in models.config.WARD_FEATURES]
    rows = [(f"w{i}", *[float(v) for v in rng.normal((i % 3) * 4, 1.5, len(cols))]) for i in range(90)]
    rows += [(f"v{i}", *rows[0][1:]) for i in range(4)]
    profiles = spark.createDataFrame(rows, "ward string, " + ", ".join(f"`{c}` double" for c in cols))
    x = np.array([r[1:] for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)

    def cost(starts):
        label = {r["ward"]: r["cluster"] for r in clustering.assign_clusters(profiles, 3, starts=starts).collect()}
        label = np.array([label[r[0]] for r in rows])
        assert len({label[i] for i in (0, 90, 91, 92, 93)}) == 1
        centres = [x[label == k].mean(axis=0) for k in range(3)]
        near = np.array([((x - c) ** 2).sum(axis=1) for c in centres]).argmin(axis=0)
        assert (near == label).all()  # a resting state: every row is at its nearest mean
        return sum(((x[label == k] - c) ** 2).sum() for k, c in enumerate(centres))

    group = np.array([i % 3 for i in range(90)] + [0] * 4)
    planted = sum(((x[group == k] - x[group == k].mean(axis=0)) ** 2).sum() for k in range(3))
    assert cost(10) <= planted + 1e-6 and cost(10) <= cost(1) + 1e-6


def test_training_job_stores_its_metrics(spark, waves, few_trees, tmp_path):
    """No features are stored, so the merged table is used; the model that fails is not stored."""
    from zephyria.plans import jobs
    from zephyria.sources.metrics_store import read_metrics

    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        jobs.train(spark, root)
    daily = waves.withColumns({"season": F.lit("Summer"), "wind_speed": F.lit(1.0), "pressure": F.lit(1000.0)})
    daily.write.parquet(jobs.processed(root, "merged_dataset"))
    out = {r["model"]: r["error"] for r in jobs.train(spark, root, ["forecast_aqi", "forecast_temp_ctx"]).collect()}
    assert out["forecast_temp_ctx"] is None and out["forecast_aqi"]
    stored = read_metrics(spark, f"{root}/models/metrics").collect()
    assert [r["model"] for r in stored] == ["forecast_temp_ctx"] and stored[0]["RMSE"] > 0
