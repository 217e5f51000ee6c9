import datetime as dt

import pytest
from frames import column, series
from pyspark.sql import functions as F

from zephyria.operators import aggregates, columns, joins, metrics, ordering, scaling, spatial
from zephyria.plans import jobs
from zephyria.sources import schemas, tables
from zephyria.sources.metrics_store import compare, confusion_rows, long_form, read_metrics, write_metrics


def test_absent_table_is_empty(spark, tmp_path):
    df = tables.scan(spark, str(tmp_path / "nothing"), schemas.WARD)
    assert df.count() == 0 and df.columns == schemas.WARD.fieldNames()
    assert tables.scan_first(spark, [(str(tmp_path / "a"), schemas.AIR)]) is None
    assert jobs.seasonal(spark, str(tmp_path)) == {}
    assert jobs.risks(spark, str(tmp_path)) is None


def test_first_existing_table_wins(spark, tmp_path):
    for name, v in (("second", 2.0), ("third", 3.0)):
        tables.write_table(series(spark, {"aqi": [v]}), str(tmp_path / name), fmt="csv")
    schema = series(spark, {"aqi": [1.0]}).schema
    found = tables.scan_first(spark, [(str(tmp_path / n), schema) for n in ("first", "second", "third")])
    assert column(found, "aqi") == [2.0]


def test_written_years_are_pruned(spark, tmp_path):
    df = columns.add_calendar(series(spark, {"x": [1.0] * 800}))
    tables.write_table(df, str(tmp_path / "t"))
    hit = columns.year_range(spark.read.parquet(tables.current(spark, str(tmp_path / "t"))), 2021, 2021)
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and hit.count() == 365


def test_year_cap_falls_back_to_everything(spark):
    df = columns.add_calendar(series(spark, {"x": [1.0] * 400}))
    assert columns.year_cap(df, 2020).count() == 366
    assert columns.year_cap(df, 2019).count() == 400


def test_scaling_conventions(spark):
    df = series(spark, {"x": [1.0, 2.0, 4.0], "flat": [5.0, 5.0, 5.0]})
    scaled = scaling.minmax(df, ["x", "flat", "absent"])
    assert column(scaled, "x") == pytest.approx([0, 1 / 3, 1]) and column(scaled, "flat") == [0.0, 0.0, 0.0]
    std = scaling.standardise(df, ["x", "flat"])
    assert column(std, "flat") == [0.0, 0.0, 0.0]
    assert sum(v * v for v in column(std, "x")) == pytest.approx(3.0)
    bounds = scaling.ranges(df, ["x", "flat"])
    back = scaling.inverse_minmax(scaling.minmax(df, ["x", "flat"], bounds), "x", "x", bounds)
    assert column(back, "x") == pytest.approx([1.0, 2.0, 4.0])
    one = scaling.minmax(series(spark, {"x": [3.0]}), ["x"])
    assert column(one, "x") == [0.0]


def test_cutover_leaves_no_overlap(spark):
    old = series(spark, {"aqi": [1.0] * 10})
    new = series(spark, {"aqi": [2.0] * 10})
    out = ordering.union_cutover(old, new, "2020-01-05", "2020-01-08").orderBy("date").collect()
    assert [r["aqi"] for r in out] == [1.0] * 4 + [2.0] * 4
    assert len({r["date"] for r in out}) == 8


def test_spine_shows_gaps(spark):
    rows = [(1, dt.date(2021, 3, 1)), (2, dt.date(2021, 3, 1)), (1, dt.date(2021, 3, 3))]
    spine = ordering.date_spine(spark.createDataFrame(rows, "station_id long, date date"))
    counts = {r["date"]: r["n_rows"] for r in spine.collect()}
    assert len(counts) == 365 and counts[dt.date(2021, 3, 1)] == 2 and counts[dt.date(2021, 3, 2)] == 0


def test_merge_suffixes_only_clashes(spark):
    weather = columns.add_calendar(series(spark, {"temperature_mean": [1.0, 2.0], "humidity": [50.0, 60.0]}))
    air = series(spark, {"aqi": [10.0, 20.0], "humidity": [1.0, 2.0]})
    merged = joins.join_weather_air(weather, air)
    assert column(merged, "humidity_aqi") == [1.0, 2.0] and column(merged, "humidity") == [50.0, 60.0]
    assert not [c for c in merged.columns if c.endswith("_aqi") and c != "humidity_aqi"]


def test_trend_needs_two_years(spark):
    one = columns.add_calendar(series(spark, {"temperature_mean": [1.0] * 10, "rainfall": [None] * 10}))
    row = aggregates.annual_trend(one).collect()[0]
    assert row["temperature_mean_trend_slope"] is None and row["rainfall_trend_slope"] is None
    two = one.unionByName(one.withColumns({"year": F.lit(2021), "temperature_mean": F.lit(1.5)}))
    rows = aggregates.annual_trend(two).collect()
    assert {r["temperature_mean_trend_slope"] for r in rows} == {0.5}


def test_shares_sum_to_one_and_absent_levels_are_zero(spark):
    rows = [("Winter", "Low"), ("Winter", "High"), ("Winter", "Low"), ("Summer", "Medium"), (None, "Low"), ("Summer", None)]
    out = {r["season"]: r for r in aggregates.flood_shares(spark.createDataFrame(rows, "season string, flood_risk string")).collect()}
    assert set(out) == {"Winter", "Summer"}
    assert (out["Winter"]["Low"], out["Winter"]["Medium"], out["Winter"]["High"]) == (0.667, 0.0, 0.333)
    for r in out.values():
        assert r["Low"] + r["Medium"] + r["High"] == pytest.approx(1, abs=0.002)


def test_hotspot_ties_at_the_threshold(spark):
    rows = [(2020, f"w{i}", t, 1.0, 1.0, 0.0, 0.0) for i, t in enumerate([20.0, 30.0, 30.0, 30.0, 10.0])]
    wards = spark.createDataFrame(rows, "year int, ward string, avg_temp double, avg_aqi double, ndvi double, lat double, lon double")
    hot = {r["ward"]: r["is_uhi_hotspot"] for r in spatial.heat_hotspots(wards).collect()}
    assert hot == {"w0": 0, "w1": 1, "w2": 1, "w3": 1, "w4": 0}


def test_metrics_against_hand_counts(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "actual string, predicted string")
    m = metrics.classification_metrics(df).collect()[0]
    f1 = {"a": 2 * 1 / (2 + 2), "b": 2 * 2 / (2 + 3), "c": 0.0}
    assert m["Accuracy"] == 0.6
    assert m["F1_weighted"] == pytest.approx((f1["a"] * 2 + f1["b"] * 2 + f1["c"]) / 5, abs=1e-4)
    assert metrics.matrix_array(df).collect()[0][0] == [[1, 1, 0], [0, 2, 0], [1, 0, 0]]
    r = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "actual double, predicted double")
    assert tuple(metrics.regression_metrics(r).collect()[0]) == (0.6455, 0.5, 0.375)
    flat = spark.createDataFrame([(1.0, 1.5), (1.0, 2.0)], "actual double, predicted double")
    assert metrics.regression_metrics(flat).collect()[0]["R2"] is None


def test_metrics_store_round_trip(spark, tmp_path):
    rows = [
        ("m1", "t", 1.0, 0.5, 0.9, None, None, None),
        ("m2", None, None, None, None, 0.99, 0.98, [[3, 1], [0, 4]]),
    ]
    path = str(tmp_path / "metrics")
    write_metrics(spark.createDataFrame(rows, schemas.METRIC), path)
    stored = read_metrics(spark, path)
    assert stored.count() == 2 and long_form(stored).count() == 5
    assert [r["model"] for r in compare(stored, "RMSE").collect()] == ["m1"]
    cells = {(r["actual"], r["predicted"]): r["n"] for r in confusion_rows(spark, path).collect()}
    assert cells == {(0, 0): 3, (0, 1): 1, (1, 0): 0, (1, 1): 4}


def test_spatial_job_reports(spark, tmp_path):
    rows = [
        (y, f"w{i}", 12.0, 77.0, 20.0 + i, 10.0 * i, 50.0 + i, 0.1 * i, 5.0 * i, None, r, None, None)
        for y, r in ((2020, "Low"), (2021, "High"), (2022, "High"))
        for i in range(8)
    ]
    tables.write_table(spark.createDataFrame(rows, schemas.WARD), f"{tmp_path}/raw/ward", fmt="csv")
    out = {name: jobs.spatial_report(spark, str(tmp_path), name) for name in jobs.SPATIAL_REPORTS}
    assert out["flood_zones"].count() == 8
    assert out["hotspots"].where("is_uhi_hotspot = 1").count() == 2
    clusters = {r["ward"]: r["cluster"] for r in out["clusters"].collect()}
    assert len(clusters) == 8 and set(clusters.values()) == set(range(5))


def test_scans_go_by_name(spark, tmp_path):
    """Another column order, an unknown column, no station, and no declared column at all."""
    path = str(tmp_path / "air")
    tables.write_table(spark.createDataFrame([(7.5, "n", 3.0, "2020-01-02")], "aqi double, note string, pm25 double, date string"), path, fmt="csv")
    row = tables.scan(spark, path, schemas.AIR).collect()[0]
    assert (row.station_id, row.date, row.aqi, row.pm25, row.o3) == (0, dt.date(2020, 1, 2), 7.5, 3.0, None)
    land = str(tmp_path / "land")
    tables.write_table(spark.createDataFrame([(2020, 0.5)], "year int, ndvi double"), land, fmt="csv")
    assert tables.scan(spark, land, schemas.LAND_USE).collect()[0].region_id == "all"
    other = str(tmp_path / "other")
    tables.write_table(spark.createDataFrame([(1,)], "unrelated int"), other, fmt="csv")
    with pytest.raises(ValueError):
        tables.scan(spark, other, schemas.AIR)


def stored(spark, path):
    return spark.read.parquet(tables.current(spark, path))


def test_writing_replaces_a_table_and_may_read_it(spark, tmp_path):
    path = str(tmp_path / "t")
    df = columns.add_calendar(series(spark, {"x": [1.0] * 800}))
    tables.write_table(df, path)
    opened = stored(spark, path)
    for _ in range(3):
        tables.write_table(stored(spark, path).withColumn("x", F.col("x") + 1), path)
        if tables.versions(spark, path)[-1][0] == 2:
            assert opened.agg(F.sum("x")).collect()[0][0] == 800  # the version before is still there
    assert stored(spark, path).agg(F.sum("x")).collect()[0][0] == 3200
    assert [n for n, _ in tables.versions(spark, path)] == [3, 4]
    assert len([f for f in (tmp_path / "t").glob("v-*")]) == 2


def test_a_write_that_dies_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = columns.add_calendar(series(spark, {"x": [float(i) for i in range(800)]}))
    tables.write_table(df, path)
    broken = F.when(F.col("x") < 799, F.col("x")).otherwise(F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        tables.write_table(df.withColumn("x", broken), path)
    assert stored(spark, path).count() == 800
    df.limit(3).write.parquet(f"{path}/v-unpublished")  # complete, but its writer died before publishing
    assert stored(spark, path).count() == 800 and tables.find(spark, path, None, "parquet").count() == 800
    tables.write_table(df.limit(5), path)
    assert stored(spark, path).count() == 5


def test_years_get_files_by_their_bytes(spark, tmp_path):
    """A heavy year is split, light ones are not spread."""
    days = columns.add_calendar(series(spark, {"x": [0.5] * 800}))
    heavy = days.join(spark.range(0, 400).withColumnRenamed("id", "copy"), F.col("year") == 2020).withColumn("noise", F.rand(1))
    light = days.where("year > 2020").withColumns({"copy": F.lit(0).cast("long"), "noise": F.rand(2)})
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        tables.write_table(heavy.unionByName(light), str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {y: len(list((tmp_path / "t").glob(f"v-*/year={y}/*.parquet"))) for y in (2020, 2021, 2022)}
    assert files[2020] >= 4 and files[2021] == files[2022] == 1


def weather_rows(spark, n=40):
    measures = {c: [20.0 + i % 5 for i in range(n)] for c in ("temperature_max", "temperature_min", "temperature_mean", "rainfall", "wind_speed", "humidity", "pressure")}
    return columns.add_calendar(series(spark, measures), ("year", "month", "day", "doy", "season"))


def test_preprocess_touches_nothing_without_both_inputs(spark, tmp_path):
    root = str(tmp_path)
    air = series(spark, {c: [30.0] * 40 for c in ("pm25", "pm10", "no2", "so2", "co", "o3", "aqi")})
    tables.write_table(weather_rows(spark), jobs.raw(root, "meteorological"), fmt="csv")
    tables.write_table(air, jobs.raw(root, "aqi"), fmt="csv")
    assert jobs.preprocess(spark, root).count() == 40
    (tmp_path / "raw" / "aqi").rename(tmp_path / "raw" / "elsewhere")
    with pytest.raises(FileNotFoundError):
        jobs.preprocess(spark, root)
    assert stored(spark, jobs.processed(root, "merged_dataset")).count() == 40
    assert stored(spark, jobs.processed(root, "aqi_processed")).count() == 40


def test_job_tables_are_not_moved_to_be_written(spark, tmp_path):
    """Whoever reads them reads every year, so the tasks that work rows out write them."""
    root = str(tmp_path)
    air = series(spark, {c: [30.0] * 400 for c in ("pm25", "pm10", "no2", "so2", "co", "o3", "aqi")})
    tables.write_table(weather_rows(spark, 400), jobs.raw(root, "meteorological"), fmt="csv")
    tables.write_table(air, jobs.raw(root, "aqi"), fmt="csv")
    jobs.preprocess(spark, root)
    years = {(r["year"], r["count"]) for r in jobs.features(spark, root).groupBy("year").count().collect()}
    assert sum(n for _, n in years) == 400 and len(years) == 2
    for name in ("met_processed", "aqi_processed", "merged_dataset", "features_dataset"):
        found = list((tmp_path / "processed" / name).glob("v-*"))
        assert list(found[0].glob("*.parquet")) and not list(found[0].glob("year=*"))


def test_job_tables_meet_without_being_moved(spark, tmp_path, monkeypatch):
    """The cleaned tables are joined, and the merged one gets its features, in the buckets of their stations."""
    root, plans = str(tmp_path), {}
    air = series(spark, {c: [30.0] * 40 for c in ("pm25", "pm10", "no2", "so2", "co", "o3", "aqi")})
    tables.write_table(weather_rows(spark), jobs.raw(root, "meteorological"), fmt="csv")
    tables.write_table(air, jobs.raw(root, "aqi"), fmt="csv")
    for name in ("write_clustered", "write_table"):
        write = getattr(jobs, name)

        def seen(df, path, *rest, write=write, **more):
            plans[path.rsplit("/")[-1]] = df._jdf.queryExecution().executedPlan().toString()
            write(df, path, *rest, **more)

        monkeypatch.setattr(jobs, name, seen)
    jobs.preprocess(spark, root)
    assert jobs.features(spark, root).count() == 40
    assert "Exchange" in plans["met_processed"] and "Exchange" in plans["aqi_processed"]
    assert "Join" in plans["merged_dataset"] and "Window" in plans["features_dataset"]
    assert not [n for n in ("merged_dataset", "features_dataset") if "Exchange" in plans[n]]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("clustered")]


def test_clustered_tables_are_read_as_they_are_stored(spark, tmp_path):
    rows = [(None, 1.0, "a'b"), (1, 2.0, None), (1, 2.0, None), (2, None, "c")]
    df, path = spark.createDataFrame(rows, "station_id long, `x y` double, z string"), str(tmp_path / "it's")
    tables.write_table(df, path)
    assert sorted(tables.clustered(spark, path, "station_id").collect(), key=str) == sorted(df.collect(), key=str)
    tables.write_clustered(df, path, "station_id", 4)
    found = tables.clustered(spark, path, "station_id")
    assert sorted(found.collect(), key=str) == sorted(df.collect(), key=str) == sorted(stored(spark, path).collect(), key=str)
    tables.write_clustered(found, path, "station_id", 8)
    assert tables.clustered(spark, path, "station_id").count() == 4 and len(tables.versions(spark, path)) == 2


def test_risks_without_air_use_the_defaults(spark, tmp_path):
    root = str(tmp_path)
    tables.write_table(weather_rows(spark), jobs.raw(root, "meteorological"), fmt="csv")
    scored = jobs.risks(spark, root)
    assert scored.where("health_risk_score is null").count() == 0
    assert scored.where("health_risk_label <> 'Severe'").count() > 0


def test_metrics_documents_of_either_shape(spark, tmp_path):
    keyed, lines, other = (tmp_path / n for n in ("keyed.json", "lines.json", "other.json"))
    keyed.write_text('{"m1": {"task": "t", "RMSE": 1.5},\n "m2": {"Accuracy": 0.5, "ConfusionMatrix": [[1, 0], [0, 2]]}}')
    lines.write_text('{"model": "m1", "task": "t", "RMSE": 1.5}\n{"model": "m2", "Accuracy": 0.5}\n')
    other.write_text('{"m1": {"something": "else"}}')
    for path in (keyed, lines):
        got = {r.model: (r.RMSE, r.Accuracy) for r in read_metrics(spark, str(path)).collect()}
        assert got == {"m1": (1.5, None), "m2": (None, 0.5)}
    assert confusion_rows(spark, str(keyed)).count() == 4
    with pytest.raises(Exception, match="no known metric"):
        read_metrics(spark, str(other)).collect()


def test_labels_are_numbered_in_ranges(spark):
    labels = [f"same prefix {i % 3000:x}" for i in range(6000)] + ["", "é", None]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    out = columns.encode_labels(df, "label", "code")
    code = {x: i for i, x in enumerate(sorted({x.encode() for x in labels if x is not None}))}
    got = out.collect()
    assert len(got) == len(labels) and all(r.code == (None if r.label is None else code[r.label.encode()]) for r in got)
    windows = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "row_number" in line]
    assert windows and all("_range" in line for line in windows)


def test_labels_of_a_large_vocabulary(spark):
    df = spark.range(100_000).withColumn("label", F.format_string("label-%06d", F.col("id")))
    out = columns.encode_labels(df, "label", "code")
    assert out.where("code <> id").count() == 0 and out.count() == 100_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
    none = columns.encode_labels(spark.createDataFrame([("b",), (None,), ("a",)], "label string"), "label", "code", fill="c")
    assert sorted(r.code for r in none.collect()) == [0, 1, 2]


def test_rows_of_a_hot_label_are_spread(spark):
    """Three labels are no three tasks: rows of frequent labels, and of none, are dealt by their other columns."""
    label = F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 8, "b").when(F.col("id") % 10 < 9, "c")
    df = spark.range(20_000).withColumn("label", label).repartition(4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(kept, ("false", "-1", "8")):
            spark.conf.set(k, v)
        coded = columns.encode_labels(df, "label", "code")
        tasks = coded.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
        codes = {(r.label, r.code) for r in coded.select("label", "code").distinct().collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert codes == {("a", 0), ("b", 1), ("c", 2), (None, None)}
    assert sum(r.n for r in tasks) == 20_000 and max(r.n for r in tasks) < 20_000 / 4


def test_matrix_of_too_many_labels_is_an_error(spark):
    df = spark.range(metrics.MOST_CLASSES + 5).select(F.col("id").alias("actual"), F.col("id").alias("predicted"))
    with pytest.raises(Exception, match="at most"):
        metrics.confusion_matrix(df).count()


def test_all_numeric_measures_are_filled(spark):
    from zephyria.operators import gaps

    df = series(spark, {"x": [1.0, None, 3.0]}).selectExpr(
        "*", "cast(x as float) as f", "cast(x as decimal(10, 2)) as d", "cast(x as int) as i"
    )
    for out in (gaps.interpolate(df), gaps.fill_nearest(df)):
        assert all(None not in column(out, c) for c in ("x", "f", "d", "i"))


def test_days_of_any_parameter(spark, tmp_path):
    from zephyria.sources import feeds

    doc = '{"station_id": 1, "properties": {"parameter": {"RH2M": {"20200101": 50.0}, "PS": {"20200102": 100.1}}}}'
    (tmp_path / "feed.json").write_text(doc)
    rows = {str(r.date): (r.humidity, r.pressure) for r in feeds.parameter_feed(spark, str(tmp_path / "feed.json")).collect()}
    assert rows == {"2020-01-01": (50.0, None), "2020-01-02": (None, 100.1)}


def test_columns_of_a_row_alone_are_not_moved(spark, tmp_path):
    """What ``then`` adds is worked out behind the shuffle that gathers the years."""
    seen = []
    df = spark.range(20).select("id", (F.col("id") % 2 + 2020).cast("int").alias("year"))

    def then(gathered):
        seen.append(gathered)
        return gathered.withColumn("double", F.col("id") * 2)

    tables.write_table(df, str(tmp_path / "t"), then=then)
    assert "rebalance" in seen[0]._jdf.queryExecution().logical().toString().lower()
    back = spark.read.parquet(tables.current(spark, str(tmp_path / "t")))
    assert sorted((r["id"], r["double"], r["year"]) for r in back.collect()) == [(i, 2 * i, 2020 + i % 2) for i in range(20)]


def test_risk_scores_are_not_moved(spark, tmp_path, monkeypatch):
    handed = {}

    def kept(df, path, *a, then=None, **k):
        handed["before"], handed["after"] = df.columns, then(df).columns
        raise StopIteration

    stored = spark.createDataFrame([(1, 30.0, 50.0, 2020)], "station_id int, temperature_mean double, aqi double, year int")
    monkeypatch.setattr(jobs, "best_daily", lambda *a: stored)
    monkeypatch.setattr(jobs, "write_table", kept)
    with pytest.raises(StopIteration):
        jobs.risks(spark, str(tmp_path))
    assert "health_risk_score" not in handed["before"] and "health_risk_score" in handed["after"]
