"""Rolling, lag, difference, running and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyria.catalog import sqltext as q
from zephyria.catalog.column_queries import KEY, obs
from zephyria.catalog.registry import query
from zephyria.functions.numeric import rnd
from zephyria.operators import spatial, windows
from zephyria.sources import warehouse

OBS = q.with_(q.OBS)


def _rolled(n: int) -> dict[str, tuple[str, int, int]]:
    return {f"{c}_{n}d_avg": (c, n, 2) for c in ("temperature_mean", "rainfall", "humidity")}


@query(
    "roll_7",
    OBS
    + "select station_id, date, "
    + ", ".join(f"{q.rolled(c, 7, 2)} as {n}" for n, (c, _, _) in _rolled(7).items())
    + f", {q.rolled('aqi', 7, 1)} as aqi_7d_avg from obs",
)
def roll_7(spark, sf):
    out = {**_rolled(7), "aqi_7d_avg": ("aqi", 7, 1)}
    return windows.rolling_mean(obs(spark, sf), out).select(*KEY, *out)


@query(
    "roll_30",
    OBS
    + "select station_id, date, "
    + ", ".join(f"{q.rolled(c, 30, 2)} as {n}" for n, (c, _, _) in _rolled(30).items())
    + " from obs",
)
def roll_30(spark, sf):
    return windows.rolling_mean(obs(spark, sf), _rolled(30)).select(*KEY, *_rolled(30))


@query("rainfall_anomaly", OBS + f"select station_id, date, rainfall, {q.anomaly('rainfall')} as rainfall_anomaly from obs")
def rainfall_anomaly(spark, sf):
    return windows.rolling_anomaly(obs(spark, sf).select(*KEY, "rainfall"), "rainfall", "rainfall_anomaly")


def _lag_sql(k: int) -> str:
    cols = ("temperature_mean", "humidity")
    raw = ", ".join(f"lag({c}, {k}) over (partition by station_id order by date) as {c}_lag{k}_raw" for c in cols)
    return (
        q.with_(q.OBS, f"l as (select station_id, date, {raw} from obs)")
        + f"select station_id, date, {', '.join(q.backfilled(f'{c}_lag{k}') for c in cols)} from l"
    )


def _lagged(spark, sf, k: int):
    out = {f"{c}_lag{k}": (c, k) for c in ("temperature_mean", "humidity")}
    return windows.lag_filled(obs(spark, sf), out).select(*KEY, *out)


@query("lag_1", _lag_sql(1))
def lag_1(spark, sf):
    return _lagged(spark, sf, 1)


@query("lag_7", _lag_sql(7))
def lag_7(spark, sf):
    return _lagged(spark, sf, 7)


@query(
    "yearly_diff",
    q.with_(q.LAND)
    + f"""select year, ndvi, {q.r('coalesce(ndvi-lag(ndvi) over (order by year), 0e0)', 4)} as ndvi_change, built_up_pct,
 {q.r('coalesce(built_up_pct-lag(built_up_pct) over (order by year), 0e0)', 2)} as buildup_change, vegetation_pct from land""",
)
def yearly_diff(spark, sf):
    return spatial.yearly_change(warehouse.landuse_year(spark, sf))


_LOSS = f"""wl as (select year, water_pct, {q.r('(first_value(water_pct) over (order by year)-water_pct)/first_value(water_pct) over (order by year)*100e0', 2)}
 as water_loss_pct from land)"""


@query("water_loss", q.with_(q.LAND, _LOSS) + "select year, water_pct, water_loss_pct from wl")
def water_loss(spark, sf):
    return spatial.water_loss(warehouse.landuse_year(spark, sf)).drop("cumulative_loss")


@query(
    "cumulative_loss",
    q.with_(q.LAND, _LOSS)
    + """select year, water_pct, water_loss_pct, max(water_loss_pct) over (order by year rows between unbounded preceding and current row)
 as cumulative_loss from wl""",
)
def cumulative_loss(spark, sf):
    return spatial.water_loss(warehouse.landuse_year(spark, sf))


@query(
    "first_high_ward",
    q.with_(q.WARD)
    + """select ward, lat, lon, avg_temp, annual_rainfall, flood_risk from (
 select *, row_number() over (partition by ward order by year) as n from ward where flood_risk='High') z where n = 1""",
)
def first_high_ward(spark, sf):
    return spatial.flood_prone_wards(warehouse.ward_year(spark, sf))


_SEQ = ("temperature_mean", "humidity", "pressure", "wind_speed")
_FRAME = "over (partition by station_id order by date rows between 30 preceding and 1 preceding)"


@query(
    "make_sequences",
    q.with_(
        q.OBS,
        f"rws as (select * from obs where {' and '.join(f'{c} is not null' for c in _SEQ)})",
        f"sq as (select station_id, date, temperature_mean as target, {', '.join(f'array_agg({c}) {_FRAME} as {c}_l' for c in _SEQ)} from rws)",
    )
    + "select station_id, date, target, cast(len(humidity_l) as integer) as n_steps, "
    + ", ".join(
        f"{c}_l[1] as {c}_first, {c}_l[30] as {c}_last, {q.r(f'list_sum(list_transform({c}_l, lambda x, i: x*i))', 4)} as {c}_weighted"
        for c in _SEQ
    )
    + " from sq where len(humidity_l) = 30",
)
def make_sequences(spark, sf):
    """Every 30-row window, summarised by its ends and a position-weighted sum per feature."""
    return summarised(windows.sequences(obs(spark, sf), _SEQ, "temperature_mean"))


def summarised(steps):
    """Ends and position-weighted sums of 30-row windows."""

    def weighted(c: str):
        terms = F.transform("steps", lambda s, i: s[c] * (i + 1))
        return rnd(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 4)

    return steps.select(
        *KEY,
        "target",
        F.size("steps").alias("n_steps"),
        *[F.col("steps")[0][c].alias(f"{c}_first") for c in _SEQ],
        *[F.col("steps")[29][c].alias(f"{c}_last") for c in _SEQ],
        *[weighted(c).alias(f"{c}_weighted") for c in _SEQ],
    )


@query(
    "temporal_split",
    q.with_(
        q.OBS,
        """n as (select station_id, date, row_number() over (partition by station_id order by date) - 1 as i,
 count(*) over (partition by station_id) as n from obs)""",
    )
    + f"""select station_id, date, case when i < floor({q.g('n*0.7e0')}) then 'train' when i < floor({q.g('n*0.85e0')}) then 'validation'
 else 'test' end as split from n""",
)
def temporal_split(spark, sf):
    return windows.temporal_split(obs(spark, sf).select(*KEY))
