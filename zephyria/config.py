"""Fixed values of the climate domain, in one place.

FIXED VALUES: the bands, seasons, code tables, weights, coefficients and
defaults below define the results, so they are stated literally and are not
tuned here.
"""

from __future__ import annotations

# --- series identity -------------------------------------------------------
STATION = "station_id"
DATE = "date"
#: key of the rows of a stored table that names no station or region
DEFAULT_STATION = 0
DEFAULT_REGION = "all"

# --- seasons ---------------------------------------------------------------
SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Summer": (3, 4, 5),
    "Southwest Monsoon": (6, 7, 8, 9),
    "Post-Monsoon": (10, 11),
}
UNKNOWN_SEASON = "Unknown"
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# --- class bands: (label, low, high) ----------------------------------------
# half-open [low, high); anything outside every band takes the last label
TEMPERATURE_BANDS = (("Normal", 0, 30), ("Hot", 30, 35), ("Very Hot", 35, 40), ("Heat-Wave", 40, 999))
RAINFALL_BANDS = (
    ("No Rain", 0, 0.1),
    ("Light", 0.1, 7.5),
    ("Moderate", 7.5, 35.5),
    ("Heavy", 35.5, 64.4),
    ("Extreme", 64.4, 9999),
)
# closed [low, high]; the gaps between bands take the last label
AQI_BANDS = (("Good", 0, 50), ("Moderate", 51, 100), ("Poor", 101, 200), ("Very Poor", 201, 9999))

# upper-exclusive score steps: (limit, label), then the last label
FLOOD_STEPS = ((15, "Low"), (45, "Medium"))
FLOOD_TOP = "High"
HEALTH_STEPS = ((25, "Low"), (50, "Moderate"), (75, "High"))
HEALTH_TOP = "Severe"
# upper-inclusive point steps
DENGUE_STEPS = ((1, "Low"), (3, "Medium"))
DENGUE_TOP = "High"

# --- label codes: (table, code of an unknown or missing label) --------------
AQI_CODES = ({"Good": 0, "Moderate": 1, "Poor": 2, "Very Poor": 3}, 1)
SEASON_CODES = ({"Winter": 0, "Summer": 1, "Southwest Monsoon": 2, "Post-Monsoon": 3}, 0)
RISK_CODES = {
    "health_risk": ({"Low": 0, "Moderate": 1, "High": 2, "Severe": 3}, 0),
    "flood_risk": ({"Low": 0, "Medium": 1, "High": 2}, 0),
    "dengue_risk": ({"Low": 0, "Medium": 1, "High": 2}, 0),
    "temp_class": ({"Normal": 0, "Hot": 1, "Very Hot": 2, "Heat-Wave": 3}, 0),
    "rain_class": ({"No Rain": 0, "Light": 1, "Moderate": 2, "Heavy": 3, "Extreme": 4}, 0),
}

# --- indicator coefficients -------------------------------------------------
# regression on deg F (t) and relative humidity (h): (power of t, power of h, factor)
HEAT_INDEX_TERMS = (
    (0, 0, -42.379),
    (1, 0, 2.04901523),
    (0, 1, 10.14333127),
    (1, 1, -0.22475541),
    (2, 0, -0.00683783),
    (0, 2, -0.05481717),
    (2, 1, 0.00122874),
    (1, 2, 0.00085282),
    (2, 2, -0.00000199),
)
HEAT_INDEX_FROM = 27
RURAL_BASE_TEMP = 26.5
HEALTHY_NDVI = 0.55
EPSILON = 1e-9

# --- composite health score -------------------------------------------------
HEALTH_WEIGHTS = {
    "heat_exhaustion": 0.20,
    "dehydration": 0.10,
    "respiratory": 0.20,
    "flood_health": 0.10,
    "dengue_vector": 0.15,
    "sleep_disturb": 0.10,
    "productivity": 0.15,
}
# used only where the whole column is absent; the minimum follows the mean
ABSENT_HEALTH_INPUTS = {
    "temperature_mean": 29.0,
    "temperature_min": ("temperature_mean", -4.0),
    "humidity": 65.0,
    "wind_speed": 12.0,
    "rainfall": 3.0,
    "aqi": 80.0,
    "pm25": 40.0,
}

# --- cleaning ---------------------------------------------------------------
OUTLIER_Z = 3.5
MISSING_SENTINEL = -999.0
HUMIDITY_RANGE = (20.0, 100.0)
PRESSURE_RANGE = (970.0, 1030.0)
FEED_DEFAULTS = {"humidity": 65.0, "pressure": 1010.0}
WEATHER_OUTLIER_COLUMNS = (
    "temperature_mean",
    "temperature_max",
    "temperature_min",
    "rainfall",
    "humidity",
    "wind_speed",
    "pressure",
)
AIR_COLUMNS = ("pm25", "pm10", "no2", "so2", "co", "o3", "aqi")
ROLLED_COLUMNS = ("temperature_mean", "rainfall", "humidity")
LAGGED_COLUMNS = ("temperature_mean", "rainfall", "aqi", "humidity")
AIR_OBSERVED_FROM = "2022-01-01"

# --- reports ----------------------------------------------------------------
SEASONAL_COLUMNS = ("temperature_mean", "temperature_max", "rainfall", "humidity", "wind_speed", "aqi", "pm25")
MONTHLY_COLUMNS = ("temperature_mean", "temperature_max", "temperature_min", "rainfall", "humidity", "wind_speed")
TREND_COLUMNS = ("temperature_mean", "rainfall", "humidity", "aqi", "pm25")
POLLUTANT_COLUMNS = ("pm25", "pm10", "no2", "so2", "o3")
WARD_FEATURES = ("avg_temp", "annual_rainfall", "avg_aqi", "ndvi", "buildup_pct")
HOTSPOT_COLUMNS = ("avg_temp", "avg_aqi", "ndvi", "lat", "lon")
LAND_CLASS_LABELS = {
    "built_up_pct": "Built-Up",
    "vegetation_pct": "Vegetation",
    "water_pct": "Water Bodies",
    "bare_land_pct": "Bare Land",
}
FLOOD_COLOURS = ({"Low": "#3fb950", "Medium": "#d29922", "High": "#f78166"}, "#8b949e")
HEAT_WAVE_ABOVE = 40.0
RAINY_ABOVE = 2.5
EXTREME_RAIN_ABOVE = 64.4
POOR_AIR_ABOVE = 100.0
BASELINE_YEARS = 5
RISK_WINDOW_ROWS = 365

# --- models -----------------------------------------------------------------
SEED = 42
SEQUENCE_LENGTH = 30
TRAIN_FRACTION = 0.70
VALIDATION_FRACTION = 0.15
HOLDOUT_PERCENT = 25
FORECAST_TREES = 50
