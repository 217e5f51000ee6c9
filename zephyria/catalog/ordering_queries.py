"""Sort, first/last rows, unions and distinct rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyria.catalog import sqltext as q
from zephyria.catalog.column_queries import KEY, obs
from zephyria.catalog.registry import query
from zephyria.functions.numeric import guard
from zephyria.operators import ordering
from zephyria.operators.aggregates import MEAN_DIGITS, annual_means
from zephyria.operators.columns import add_calendar
from zephyria.operators.windows import first_per_key
from zephyria.plans.daily import score_health
from zephyria.sources import warehouse

OBS = q.with_(q.OBS)


@query("sort_date", OBS + "select station_id, date, aqi from obs order by date, station_id")
def sort_date(spark, sf):
    return ordering.sort_series(obs(spark, sf).select(*KEY, "aqi"))


@query("sort_year", q.with_(q.WARD) + "select year, ward, avg_temp from ward order by year, ward")
def sort_year(spark, sf):
    wards = warehouse.ward_year(spark, sf).select("year", "ward", "avg_temp")
    return ordering.sort_series(wards, "year", ["ward"])


@query(
    "tail_n",
    q.with_(q.OBS, "rk as (select *, row_number() over (partition by station_id order by date desc) as n from obs)")
    + "select station_id, date, aqi, humidity from rk where n <= 30",
)
def tail_n(spark, sf):
    """The last 30 rows of every station."""
    return ordering.last_rows_per_key(obs(spark, sf).select(*KEY, "aqi", "humidity"), 30)


@query(
    "head_n",
    q.with_(q.OBS, q.DAILY)
    + f"""select year, {q.r('avg(temperature_mean)', 6)} as temperature_mean from daily group by year order by year limit 5""",
)
def head_n(spark, sf):
    """The first five annual means."""
    annual = annual_means(add_calendar(obs(spark, sf), ("year",)), ["temperature_mean"], MEAN_DIGITS)
    return ordering.first_rows(annual, 5, ["year"])


@query(
    "first_last",
    q.with_(
        q.OBS,
        """rk as (select station_id, date, aqi, row_number() over (partition by station_id order by date) as a,
 row_number() over (partition by station_id order by date desc) as b from obs)""",
    )
    + """select station_id, date, aqi, 'first' as edge from rk where a = 1
 union all select station_id, date, aqi, 'last' from rk where b = 1""",
)
def first_last(spark, sf):
    days = obs(spark, sf).select(*KEY, "aqi")
    first = ordering.edge_row_per_key(days, ["station_id"], "date", last=False)
    last = ordering.edge_row_per_key(days, ["station_id"], "date")
    return first.withColumn("edge", F.lit("first")).unionByName(last.withColumn("edge", F.lit("last")))


@query(
    "latest_risk",
    q.with_(
        q.OBS,
        *q.scored("obs", "sc", "station_id, date"),
        "rk as (select *, row_number() over (partition by station_id order by date desc) as n from sc)",
    )
    + """select station_id, date, health_risk_score, risk_heat_exhaustion, risk_respiratory, risk_dengue_vector from rk where n = 1""",
)
def latest_risk(spark, sf):
    """The newest day of each station: picked first, then scored."""
    newest = ordering.edge_row_per_key(obs(spark, sf), ["station_id"], "date")
    return score_health(newest).select(
        *KEY, "health_risk_score", "risk_heat_exhaustion", "risk_respiratory", "risk_dengue_vector"
    )


@query(
    "union_cutover",
    OBS
    + f"""select station_id, date, pm25, aqi from obs where date < date '1999-01-01'
 union all select station_id, date, {q.g('pm25*2e0')}, null from obs where date >= date '1999-01-01' and date <= date '2000-12-31'""",
)
def union_cutover(spark, sf):
    """Observations start in 1999, end in 2000 and lack one column."""
    days = obs(spark, sf)
    history = days.select(*KEY, "pm25", "aqi")
    observed = days.select(*KEY, guard(F.col("pm25") * 2.0).alias("pm25"))
    return ordering.union_cutover(history, observed, "1999-01-01", "2000-12-31")


@query(
    "union_append",
    OBS
    + """select station_id, date, humidity, so2 as solar from obs
 union all select station_id, cast(date + 3650 as date), humidity, null from obs""",
)
def union_append(spark, sf):
    days = obs(spark, sf)
    later = days.select("station_id", F.date_add("date", 3650).alias("date"), "humidity")
    return ordering.append(days.select(*KEY, "humidity", F.col("so2").alias("solar")), later)


@query(
    "distinct_key",
    q.with_(q.WARD)
    + """select year, ward, lat, lon, avg_temp from (select *, row_number() over (partition by ward order by year) as n from ward) z where n = 1""",
)
def distinct_key(spark, sf):
    wards = warehouse.ward_year(spark, sf).select("year", "ward", "lat", "lon", "avg_temp")
    return first_per_key(wards, ["ward"], "year")
