"""The two streaming forms, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyria.catalog import sqltext as q
from zephyria.catalog.column_queries import obs
from zephyria.catalog.registry import query
from zephyria.catalog.scalar_queries import _HEALTH_KEEP
from zephyria.session import scratch_path
from zephyria.sources import warehouse
from zephyria.streaming import live


@query(
    "stream_daily_mean",
    f"""select user_id as station_id, event_type as pollutant, cast(ts as date) as date, {q.r('avg(value)', 6)} as value
 from events group by 1, 2, 3""",
)
def stream_daily_mean(spark, sf):
    """Days behind the watermark from the stream; those still open are closed when it ends."""
    events = warehouse.table(spark, sf, "events")
    readings = [
        F.col("user_id").alias("station_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("pollutant"),
        "value",
    ]
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet").select(*readings)
    by = ("station_id", "pollutant")
    daily = live.stream_daily_mean(stream, ["value"], by=by)
    path = scratch_path(spark, "stream-daily")
    live.run_available(daily, path, scratch_path(spark, "stream-daily-progress"))
    emitted = spark.read.schema(daily.schema).parquet(path)
    return live.close_open_days(emitted, events.select(*readings), ["value"], by)


@query("stream_health_risk", q.with_(q.OBS, *q.scored("obs", "sc", _HEALTH_KEEP)) + "select * from sc")
def stream_health_risk(spark, sf):
    source = scratch_path(spark, "days")
    obs(spark, sf).select(*_HEALTH_KEEP.split(", ")).write.parquet(source)
    scored = live.stream_health_risk(live.stream_table(spark, source, spark.read.parquet(source)))
    path = scratch_path(spark, "stream-risk")
    live.run_available(scored, path, scratch_path(spark, "stream-risk-progress"))
    return spark.read.schema(scored.schema).parquet(path)
