import datetime as dt

from pyspark.sql import functions as F

from zephyria.streaming import live


def _write(spark, rows, path):
    spark.createDataFrame(rows, "station_id long, ts timestamp, value double").write.mode("append").parquet(path)


def test_days_are_emitted_once_and_survive_a_restart(spark, tmp_path):
    src, out, progress = (f"{tmp_path}/{n}" for n in ("src", "out", "progress"))
    day = dt.datetime(2024, 1, 1)
    _write(spark, [(1, day + dt.timedelta(hours=6 * i), float(i)) for i in range(12)], src)  # three days
    like = spark.read.parquet(src)

    def run():
        daily = live.stream_daily_mean(live.stream_table(spark, src, like), ["value"])
        live.run_available(daily, out, progress)
        return sorted((r["date"].day, r["value"]) for r in spark.read.parquet(out).collect())

    assert run() == [(1, 1.5)]  # later days may still change
    _write(spark, [(1, day + dt.timedelta(days=5), 9.0)], src)
    assert run() == [(1, 1.5), (2, 5.5), (3, 9.5)]
    assert run() == [(1, 1.5), (2, 5.5), (3, 9.5)]  # nothing new, nothing repeated


def test_late_reading_within_the_delay_counts(spark, tmp_path):
    src = f"{tmp_path}/src"
    day = dt.datetime(2024, 1, 1)
    _write(spark, [(1, day + dt.timedelta(hours=1), 2.0), (1, day + dt.timedelta(hours=30), 1.0)], src)
    _write(spark, [(1, day + dt.timedelta(hours=2), 4.0), (1, day + dt.timedelta(days=4), 1.0)], src)
    daily = live.stream_daily_mean(live.stream_table(spark, src, spark.read.parquet(src)), ["value"])
    live.run_available(daily, f"{tmp_path}/out", f"{tmp_path}/p")
    first = spark.read.parquet(f"{tmp_path}/out").where(F.col("date") == "2024-01-01").collect()
    assert [r["value"] for r in first] == [3.0]
