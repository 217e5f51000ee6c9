"""Building blocks of the check SQL: the adapter views and numeric rules as text."""

from __future__ import annotations

from collections.abc import Sequence


def g(x: str) -> str:
    """Nine-decimal guard."""
    return f"(round_even(({x})*1e9,0)/1e9+0e0)"


def r(x: str, n: int) -> str:
    return f"(round_even({g(x)}*1e{n},0)/1e{n}+0e0)"


def clip(x: str, lo: float | None = None, hi: float | None = None) -> str:
    out = f"({x})"
    if hi is not None:
        out = f"least({out}, {float(hi)}e0)"
    if lo is not None:
        out = f"greatest({out}, {float(lo)}e0)"
    return f"(case when ({x}) is not null then {out} end)"


SEASON = """case when month(date) in (12,1,2) then 'Winter' when month(date) in (3,4,5) then 'Summer'
 when month(date) in (6,7,8,9) then 'Southwest Monsoon' when month(date) in (10,11) then 'Post-Monsoon'
 else 'Unknown' end"""
CALENDAR = f"""cast(year(date) as integer) as year, cast(month(date) as integer) as month,
 cast(day(date) as integer) as day, cast(dayofyear(date) as integer) as doy, {SEASON} as season"""

_MEASURES = {
    "temperature_mean": "avg(case when l_orderkey % 997 = 0 then 200e0 else l_quantity*0.7e0+10e0 end)",
    "temperature_max": "max(l_quantity*0.7e0+10e0+1e0+l_linenumber*0.5e0)",
    "temperature_min": "min(l_quantity*0.7e0+10e0-1e0-l_linenumber*0.5e0)",
    "humidity": "avg(case when l_orderkey % 17 = 0 then null else l_discount*1000e0 end)",
    "rainfall": "avg(round_even(l_tax*100e0,0)*round_even(l_tax*100e0,0)*1.25e0)",
    "wind_speed": "avg(case when l_orderkey % 23 = 0 then null else l_linenumber*5e0 end)",
    "pressure": "avg(l_discount*600e0+970e0)",
    "aqi": "avg(l_extendedprice/250e0)",
    "pm25": "avg(l_extendedprice/400e0)",
    "pm10": "avg(l_extendedprice/250e0+l_linenumber)",
    "no2": "avg(l_quantity*2e0)",
    "so2": "avg(l_quantity*0.5e0)",
    "co": "avg(l_linenumber*0.4e0)",
    "o3": "avg(l_discount*1500e0)",
}
WEATHER = ("temperature_mean", "temperature_max", "temperature_min", "humidity", "rainfall", "wind_speed", "pressure")
AIR = ("aqi", "pm25", "pm10", "no2", "so2", "co", "o3")

OBS = (
    "obs as (select l_suppkey as station_id, cast(l_shipdate as date) as date, "
    + ", ".join(f"{r(e, 4)} as {n}" for n, e in _MEASURES.items())
    + " from lineitem group by 1, 2)"
)
MET = f"met as (select station_id, date, {', '.join(WEATHER)}, {CALENDAR} from obs)"
AQI = f"aqi_t as (select station_id, date, {', '.join(AIR)} from obs)"
DAILY = f"daily as (select *, {CALENDAR} from obs)"

WARD = f"""ward as (
 select year, ward, lat, lon, avg_temp, annual_rainfall, avg_aqi, ndvi, buildup_pct,
  case when wet < 3.95e0 then 'Low' when wet < 4.05e0 then 'Medium' else 'High' end as flood_risk
 from (select cast(year(l_shipdate) as integer) as year, n_name as ward,
   {r("12e0+(n_nationkey % 5)*0.1e0", 6)} as lat, {r("77e0+floor(n_nationkey/5)*0.1e0", 6)} as lon,
   {r("avg(l_quantity*0.7e0+10e0)", 6)} as avg_temp, {r("sum(l_tax*100e0)", 6)} as annual_rainfall,
   {r("avg(l_extendedprice/250e0)", 6)} as avg_aqi, {r("avg(l_discount*5e0)", 6)} as ndvi,
   {r("avg(l_linenumber*10e0)", 6)} as buildup_pct, {r("avg(l_tax*100e0)", 6)} as wet
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  group by year(l_shipdate), n_name, n_nationkey) w)"""


def _share(cond: str, scale: str = "1e0") -> str:
    return r(f"avg(case when {cond} then 1e0 else 0e0 end)*{scale}", 6)


LAND = f"""land as (select cast(year(o_orderdate) as integer) as year, 'all' as region_id,
 {_share("o_orderstatus='F'")} as ndvi, {_share("o_orderstatus='O'", "100e0")} as built_up_pct,
 {_share("o_orderstatus='P'", "100e0")} as vegetation_pct, {_share("o_orderpriority='5-LOW'", "100e0")} as water_pct,
 {_share("o_orderpriority='1-URGENT'", "100e0")} as bare_land_pct, {r("avg(o_totalprice/10000e0)", 6)} as lst
 from orders group by 1)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


SERIES = "partition by station_id order by date"


def interpolated(
    source: str, out: str, keep: Sequence[str], cols: Sequence[str], leading: bool = True
) -> tuple[str, str, str]:
    """CTEs filling ``cols`` of ``source`` linearly by row position into ``out``."""
    up, down = "rows between unbounded preceding and current row", "rows between current row and unbounded following"
    brackets = ", ".join(
        f"last_value({c} ignore nulls) over ({SERIES} {up}) as {c}_pv, "
        f"last_value(case when {c} is not null then _pos end ignore nulls) over ({SERIES} {up}) as {c}_pp, "
        f"first_value({c} ignore nulls) over ({SERIES} {down}) as {c}_nv, "
        f"first_value(case when {c} is not null then _pos end ignore nulls) over ({SERIES} {down}) as {c}_np"
        for c in cols
    )

    def filled(c: str) -> str:
        line = g(f"{c}_pv+({c}_nv-{c}_pv)/({c}_np-{c}_pp)*(_pos-{c}_pp)")
        tail = f", {c}_pv, {c}_nv" if leading else f", {c}_pv"
        return (
            f"coalesce(case when {c} is not null then {c} "
            f"when {c}_pv is not null and {c}_nv is not null then {line} end{tail}) as {c}"
        )

    return (
        f"{out}_i1 as (select *, row_number() over ({SERIES}) as _pos from {source})",
        f"{out}_i2 as (select *, {brackets} from {out}_i1)",
        f"{out} as (select {', '.join(keep)}, {', '.join(filled(c) for c in cols)} from {out}_i2)",
    )


def blanked(source: str, out: str, keep: Sequence[str], cols: Sequence[str]) -> str:
    part = "over (partition by station_id)"

    def one(c: str) -> str:
        z = g(f"abs(({c}-avg({c}) {part})/(stddev_samp({c}) {part}+1e-9))")
        return f"case when {z} > 3.5e0 then null else {c} end as {c}"

    return f"{out} as (select {', '.join(keep)}, {', '.join(one(c) for c in cols)} from {source})"


def rolled(c: str, n: int, digits: int) -> str:
    return r(f"avg({c}) over ({SERIES} rows between {n - 1} preceding and current row)", digits)


def temp_class(t: str) -> str:
    return (
        f"case when {t}>=0 and {t}<30 then 'Normal' when {t}>=30 and {t}<35 then 'Hot' "
        f"when {t}>=35 and {t}<40 then 'Very Hot' else 'Heat-Wave' end"
    )


def rain_class(x: str) -> str:
    return (
        f"case when {x}>=0 and {x}<0.1e0 then 'No Rain' when {x}>=0.1e0 and {x}<7.5e0 then 'Light' "
        f"when {x}>=7.5e0 and {x}<35.5e0 then 'Moderate' when {x}>=35.5e0 and {x}<64.4e0 then 'Heavy' else 'Extreme' end"
    )


def aqi_class(a: str) -> str:
    return (
        f"case when {a} between 0 and 50 then 'Good' when {a} between 51 and 100 then 'Moderate' "
        f"when {a} between 101 and 200 then 'Poor' else 'Very Poor' end"
    )


def flood_risk(rain: str, rh: str) -> str:
    s = g(f"{rain}*0.7e0+{rh}*0.3e0")
    return f"case when {s}<15 then 'Low' when {s}<45 then 'Medium' else 'High' end"


def risk_label(s: str) -> str:
    return f"case when {s}<25 then 'Low' when {s}<50 then 'Moderate' when {s}<75 then 'High' else 'Severe' end"


def health_risk(t: str, a: str, rh: str) -> str:
    return risk_label(g(f"{t}/45e0*40e0+{a}/500e0*40e0+{rh}/100e0*20e0"))


def dengue_risk(t: str, rain: str, rh: str) -> str:
    s = (
        f"(case when {t}>=25 and {t}<=35 then 2 else 0 end+case when {rain}>10 then 2 else 0 end"
        f"+case when {rh}>70 then 1 else 0 end)"
    )
    return f"case when {s}<=1 then 'Low' when {s}<=3 then 'Medium' else 'High' end"


def coded(c: str, labels: Sequence[str], default: int) -> str:
    whens = " ".join(f"when '{v}' then {i}" for i, v in enumerate(labels))
    return f"cast(case {c} {whens} else {default} end as integer)"


SEASONS = ("Winter", "Summer", "Southwest Monsoon", "Post-Monsoon")
ORDINALS = {
    "health_risk": ("Low", "Moderate", "High", "Severe"),
    "flood_risk": ("Low", "Medium", "High"),
    "dengue_risk": ("Low", "Medium", "High"),
    "temp_class": ("Normal", "Hot", "Very Hot", "Heat-Wave"),
    "rain_class": ("No Rain", "Light", "Moderate", "Heavy", "Extreme"),
}
AQI_LABELS = ("Good", "Moderate", "Poor", "Very Poor")


def heat_index(t: str, h: str) -> str:
    f = f"({t}*9e0/5e0+32e0)"
    hi = (
        f"(-42.379e0+2.04901523e0*{f}+10.14333127e0*{h}-0.22475541e0*{f}*{h}-0.00683783e0*{f}*{f}"
        f"-0.05481717e0*{h}*{h}+0.00122874e0*{f}*{f}*{h}+0.00085282e0*{f}*{h}*{h}-0.00000199e0*{f}*{f}*{h}*{h})"
    )
    return r(f"case when {t}>27 then ({hi}-32e0)*5e0/9e0 else {t} end", 2)


def discomfort(t: str, h: str) -> str:
    return r(f"{t}-0.55e0*(1e0-{h}/100e0)*({t}-14.5e0)", 2)


def uhi(t: str) -> str:
    return r(clip(f"{t}-26.5e0", 0), 2)


def pollution(pm: str, a: str) -> str:
    return r(f"{clip(f'{pm}/300e0', 0, 1)}*0.6e0+{clip(f'{a}/500e0', 0, 1)}*0.4e0", 3)


def anomaly(c: str) -> str:
    fr = f"over ({SERIES} rows between 29 preceding and current row)"
    return r(
        f"case when count({c}) {fr}=1 then {c}-avg({c}) {fr} when min({c}) {fr}=max({c}) {fr} then null "
        f"else ({c}-avg({c}) {fr})/stddev_samp({c}) {fr} end",
        3,
    )


def _score(x: str) -> str:
    return r(clip(x, 0, 100), 1)


def risk_scores(**cols: str) -> dict[str, str]:
    """The seven scores; keyword arguments replace input columns by expressions."""
    t, tmin = cols.get("t", "temperature_mean"), cols.get("tmin", "temperature_min")
    h, wind, rain = cols.get("h", "humidity"), cols.get("wind", "wind_speed"), cols.get("rain", "rainfall")
    a, pm = cols.get("a", "aqi"), cols.get("pm", "pm25")
    felt = f"{t}+0.33e0*({h}/100e0*6.105e0*exp(17.27e0*{t}/(237.7e0+{t})))-4e0"
    return {
        "heat_exhaustion": _score(f"(({felt})-27e0)/20e0*100e0"),
        "dehydration": _score(f"({t}-20e0)/20e0*50e0+(100e0-{h})/100e0*30e0+{wind}/40e0*20e0"),
        "respiratory": _score(f"0.6e0*({pm}/250e0*100e0)+0.4e0*({a}/500e0*100e0)"),
        "flood_health": _score(f"0.7e0*{rain}+0.3e0*{h}"),
        "dengue_vector": _score(
            f"(0.5e0*exp(-0.5e0*(({t}-30e0)/4e0)*(({t}-30e0)/4e0))+0.3e0*{clip(f'{rain}/50e0', 0, 1)}"
            f"+0.2e0*{clip(f'({h}-50e0)/50e0', 0, 1)})*100e0"
        ),
        "sleep_disturb": _score(f"({tmin}-20e0)/15e0*60e0+({h}-50e0)/50e0*40e0"),
        "productivity": _score(f"{clip(f'({t}-28e0)/15e0*60e0', 0, 60)}+{clip(f'{a}/500e0*40e0', 0, 40)}"),
    }


WEIGHTS = {
    "heat_exhaustion": 0.20,
    "dehydration": 0.10,
    "respiratory": 0.20,
    "flood_health": 0.10,
    "dengue_vector": 0.15,
    "sleep_disturb": 0.10,
    "productivity": 0.15,
}


def scored(source: str, out: str, keep: str, **cols: str) -> tuple[str, str]:
    """CTEs adding the seven scores, the composite and its label."""
    scores = risk_scores(**cols)
    total = r("+".join(f"risk_{k}*{w}e0" for k, w in WEIGHTS.items()), 1)
    return (
        f"{out}_s as (select {keep}, {', '.join(f'{e} as risk_{k}' for k, e in scores.items())} from {source})",
        f"{out} as (select *, {risk_label('health_risk_score')} as health_risk_label "
        f"from (select *, {total} as health_risk_score from {out}_s) q)",
    )


def quantile(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p})"


# --- composite chains ---------------------------------------------------------
_MET_KEEP = ("station_id", "date", "year", "month", "day", "doy", "season")
CLEAN_MET = (
    *interpolated("met", "met_f", _MET_KEEP, WEATHER),
    blanked("met_f", "met_b", _MET_KEEP, WEATHER),
    *interpolated("met_b", "met_c", _MET_KEEP, WEATHER),
    "cm as (select *, "
    + f"{temp_class('temperature_mean')} as temp_class, {rain_class('rainfall')} as rain_class, "
    + f"{flood_risk('rainfall', 'humidity')} as flood_risk, "
    + ", ".join(
        f"""cast(case when season='{s}' then 1 else 0 end as integer) as "season_{s.replace(' ', '_')}\"""" for s in SEASONS
    )
    + ", "
    + ", ".join(
        f"{rolled(c, n, 2)} as {c}_{n}d_avg" for c in ("temperature_mean", "rainfall", "humidity") for n in (7, 30)
    )
    + " from met_c)",
)
CLEAN_AQI = (
    *interpolated("aqi_t", "aqi_f", ("station_id", "date"), AIR),
    blanked("aqi_f", "aqi_b", ("station_id", "date"), AIR),
    *interpolated("aqi_b", "aqi_c", ("station_id", "date"), AIR),
    f"ca as (select *, {aqi_class('aqi')} as aqi_class, {rolled('aqi', 7, 1)} as aqi_7d_avg from aqi_c)",
)
MERGED = (
    "merged as (select cm.*, ca.* exclude (station_id, date), "
    + f"{health_risk('temperature_mean', 'aqi', 'humidity')} as health_risk, "
    + f"{dengue_risk('temperature_mean', 'rainfall', 'humidity')} as dengue_risk "
    + "from cm join ca on cm.station_id=ca.station_id and cm.date=ca.date)"
)


def lagged(c: str, k: int) -> str:
    return f"lag({c}, {k}) over ({SERIES}) as {c}_lag{k}_raw"


_LAGS = [(c, k) for c in ("temperature_mean", "rainfall", "aqi", "humidity") for k in (1, 7)]


def backfilled(c: str) -> str:
    return f"first_value({c}_raw ignore nulls) over ({SERIES} rows between current row and unbounded following) as {c}"


FEATURES = (
    "fe1 as (select *, "
    + f"{heat_index('temperature_mean', 'humidity')} as heat_index, "
    + f"{discomfort('temperature_mean', 'humidity')} as discomfort_index, "
    + f"{anomaly('rainfall')} as rainfall_anomaly, {uhi('temperature_mean')} as uhi_score, "
    + f"{pollution('pm25', 'aqi')} as pollution_severity, {coded('aqi_class', AQI_LABELS, 1)} as aqi_ordinal, "
    + f"{coded('season', SEASONS, 0)} as season_code, "
    + ", ".join(f"{coded(k, v, 0)} as {k}_ordinal" for k, v in ORDINALS.items())
    + ", "
    + ", ".join(lagged(c, k) for c, k in _LAGS)
    + " from merged)",
    "fe as (select * exclude ("
    + ", ".join(f"{c}_lag{k}_raw" for c, k in _LAGS)
    + "), "
    + ", ".join(backfilled(f"{c}_lag{k}") for c, k in _LAGS)
    + " from fe1)",
)
CLEANED = (OBS, MET, *CLEAN_MET)
MERGE_CHAIN = (OBS, MET, AQI, *CLEAN_MET, *CLEAN_AQI, MERGED)
FEATURE_CHAIN = (*MERGE_CHAIN, *FEATURES)
