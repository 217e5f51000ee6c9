"""Baseline predictions (the value one and seven rows earlier) to evaluate metrics on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyria.catalog.sqltext import OBS, aqi_class, r, with_
from zephyria.functions.classes import aqi_class as aqi_class_column
from zephyria.operators import metrics
from zephyria.operators.series import forward
from zephyria.sources import schemas, warehouse

LAGS = {"Persistence": 1, "Weekly": 7}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, date, actual, predicted, classes) with yesterday's value as prediction."""
    obs = warehouse.obs_daily(spark, sf_dir).select("station_id", "date", F.col("aqi").alias("actual"))
    lagged = obs.withColumn("predicted", F.lag("actual", 1).over(forward())).where(F.col("predicted").isNotNull())
    return lagged.withColumns(
        {
            "actual_class": aqi_class_column(F.col("actual")),
            "predicted_class": aqi_class_column(F.col("predicted")),
        }
    )


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, actual, predicted) of every baseline, from one pass over the series."""
    obs = warehouse.obs_daily(spark, sf_dir).select("station_id", "date", F.col("aqi").alias("actual"))
    wide = obs.withColumns({m: F.lag("actual", k).over(forward()) for m, k in LAGS.items()})
    long = wide.select("actual", *LAGS).unpivot(["actual"], list(LAGS), "model", "predicted")
    return long.where(F.col("predicted").isNotNull())


def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baseline_predictions(spark, sf_dir).withColumns(
        {"a": aqi_class_column(F.col("actual")), "p": aqi_class_column(F.col("predicted"))}
    )
    scores = metrics.regression_metrics(rows, by=["model"]).join(
        metrics.classification_metrics(rows, "a", "p", by=["model"]), "model"
    )
    matrix = F.lit(None).cast(schemas.METRIC["ConfusionMatrix"].dataType).alias("ConfusionMatrix")
    return scores.select(
        "model", F.lit("AQI Forecasting").alias("task"), *schemas.NUMERIC_METRICS, matrix
    ).select(*schemas.METRIC.fieldNames())


PRED_SQL = (
    "p0 as (select station_id, date, aqi as actual, lag(aqi, 1) over (partition by station_id order by date) as predicted from obs)",
    f"""pred as (select *, {aqi_class('actual')} as actual_class, {aqi_class('predicted')} as predicted_class
 from p0 where predicted is not null)""",
)
REGRESSION_SQL = f"""{r('sqrt(avg((actual-predicted)*(actual-predicted)))', 4)} as "RMSE",
 {r('avg(abs(actual-predicted))', 4)} as "MAE",
 {r('1e0-avg((actual-predicted)*(actual-predicted))/var_pop(actual)', 4)} as "R2\""""


def class_scores_sql(source: str, by: str = "") -> str:
    """Accuracy and weighted F1 of columns ``a``/``p`` of ``source``."""
    pick, group = (f"{by}, ", f"group by {by}") if by else ("", "")
    return f"""(select {pick}{r('sum(hits)*1e0/sum(support)', 4)} as "Accuracy",
 {r('sum(support*(case when support+guesses=0 then 0e0 else 2e0*hits/(support+guesses) end))/sum(support)', 4)} as "F1_weighted"
 from (select {pick}label, sum(s) as support, sum(q) as guesses, sum(h) as hits from (
  select {pick}a as label, 1 as s, 0 as q, case when a=p then 1 else 0 end as h from {source}
  union all select {pick}p, 0, 1, 0 from {source}) u group by {pick}label) l {group})"""


METRIC_ROWS_SQL = (
    with_(
        OBS,
        """w as (select aqi as actual, lag(aqi, 1) over s as p1, lag(aqi, 7) over s as p7 from obs
 window s as (partition by station_id order by date))""",
        """bl as (select 'Persistence' as model, actual, p1 as predicted from w where p1 is not null
 union all select 'Weekly', actual, p7 from w where p7 is not null)""",
        f"bc as (select model, actual, predicted, {aqi_class('actual')} as a, {aqi_class('predicted')} as p from bl)",
        f"reg as (select model, {REGRESSION_SQL} from bc group by model)",
        f"cls as {class_scores_sql('bc', 'model')}",
    )
    + """select model, task, "RMSE", "MAE", "R2", "Accuracy", "F1_weighted"
 from (select reg.*, cls."Accuracy", cls."F1_weighted", 'AQI Forecasting' as task from reg join cls using (model)) z"""
)
