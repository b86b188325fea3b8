"""Rows of a query and of its SQL on DuckDB, in a form that can be compared."""

import glob
import os

import duckdb
import pandas as pd


def tables(folder):
    base = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        base.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return base


def _plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(map(_plain, x))
    if hasattr(x, "isoformat"):
        return str(pd.Timestamp(x))
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    if isinstance(x, (int, float)) or type(x).__name__.startswith(("int", "float", "Decimal")):
        return round(float(x), 7)
    return x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(_plain, r)) for r in frame.itertuples(index=False, name=None)), key=str)
