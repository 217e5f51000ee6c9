"""Exact comparison of a Spark result with DuckDB's answer on the same files."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _canonical(table) -> pd.DataFrame:
    df = table.to_pandas(date_as_object=True)
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first", kind="stable").reset_index(drop=True)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names, types, row count and every value agree exactly."""
    got, want = spark_df.toArrow(), con.sql(sql).to_arrow_table()
    out = []
    if sorted(got.column_names) != sorted(want.column_names):
        only_got = set(got.column_names) - set(want.column_names)
        return [f"columns differ: spark only {only_got}, sql only {set(want.column_names) - set(got.column_names)}"]
    for c in got.column_names:
        a, b = str(got.schema.field(c).type), str(want.schema.field(c).type)
        if a.replace("large_", "") != b.replace("large_", ""):
            out.append(f"type of {c}: spark {a}, sql {b}")
    if got.num_rows != want.num_rows:
        out.append(f"rows: spark {got.num_rows}, sql {want.num_rows}")
        return out
    left, right = _canonical(got), _canonical(want)
    for c in left.columns:
        same = (left[c] == right[c]) | (left[c].isna() & right[c].isna())
        if not same.all():
            i = same[~same].index[0]
            out.append(f"{(~same).sum()} values of {c} differ, first: spark {left.loc[i].to_dict()} sql {right.loc[i].to_dict()}")
    return out
