"""Small helpers to build and read back test series."""

from __future__ import annotations

import datetime as dt

START = dt.date(2020, 1, 1)


def series(spark, columns: dict[str, list], station: int = 1):
    """One station's daily rows; missing days never occur, missing values may."""
    n = len(next(iter(columns.values())))
    rows = [(station, START + dt.timedelta(days=i), *[columns[c][i] for c in columns]) for i in range(n)]
    spec = ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame(rows, f"station_id long, date date, {spec}")


def column(df, name: str, order: str = "date") -> list:
    return [r[name] for r in df.orderBy(*[c for c in ("station_id", order) if c in df.columns]).collect()]


def scalars(spark, expr_of, values: list, kind: str = "double"):
    """The expression applied to each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr_of("x").alias("y")).collect()]
