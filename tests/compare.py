"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def database(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(directory).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iufb" or str(df[c].dtype).startswith(("Int", "Float")):
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].map(lambda v: None if v is None or v != v else v)
            if df[c].notna().any() and df[c].dropna().map(lambda v: isinstance(v, int | float)).all():
                df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), ignore_index=True, na_position="first")


SPARK_KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same columns, types and rows; else what differs first."""
    relation = con.sql(sql)
    ours = {n: SPARK_KIND.get(t, t) for n, t in spark_df.dtypes}
    theirs = dict(zip(relation.columns, map(str, relation.types), strict=True))
    if ours != theirs:
        return f"types {sorted(set(ours.items()) ^ set(theirs.items()))}"
    left, right = normal(spark_df.toPandas()), normal(relation.df())
    if len(left) != len(right):
        return f"rows {len(left)} and {len(right)}"
    for c in left.columns:
        a, b = left[c], right[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {left.loc[i].to_dict()} and {right.loc[i].to_dict()} ({(~same).sum()} rows)"
    return None
