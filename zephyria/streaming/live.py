"""Structured Streaming forms of two batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zephyria.operators.aggregates import mean_of
from zephyria.operators.series import KEYS
from zephyria.plans.daily import score_health


def stream_daily_mean(
    readings: DataFrame, values: Sequence[str], by: Sequence[str] = KEYS, ts: str = "ts", delay: str = "1 day"
) -> DataFrame:
    """Daily means of a reading stream; a day is emitted once it can no longer change.

    State is one partial sum per open day and key, whatever the reading rate.
    """
    daily = readings.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("_day"), *by)
    return daily.agg(*[mean_of(v).alias(v) for v in values]).select(
        *by, F.to_date("_day.start").alias("date"), *values
    )


def close_open_days(
    emitted: DataFrame, readings: DataFrame, values: Sequence[str], by: Sequence[str] = KEYS, ts: str = "ts"
) -> DataFrame:
    """The emitted days, and the days that were still open when the source ended.

    A stream emits a day once the watermark has passed it, for all keys alike; so what
    is open at the end are the days after the last emitted one. A batch pass over
    those (a time range, which prunes the stored readings) closes them.
    """
    last = emitted.agg(F.max("date").alias("last")).scalar()
    open_rows = readings.where(last.isNull() | (F.to_date(ts) > last))
    days = open_rows.groupBy(*by, F.to_date(ts).alias("date")).agg(*[mean_of(v).alias(v) for v in values])
    return emitted.unionByName(days.select(*emitted.columns))


def stream_health_risk(days: DataFrame) -> DataFrame:
    """The batch scorer, unchanged: it is a stateless projection."""
    return score_health(days)


def run_available(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append everything available now to a Parquet table, then stop.

    Progress lives in ``checkpoint``, so a restart continues without loss or repeat.
    """
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def stream_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Stream a Parquet location with the columns of ``like``."""
    return spark.readStream.schema(like.schema).parquet(path)
