"""Compare a query with its SQL, as the driver does: rows in any order, columns by name."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(v) -> str:
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(cell, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{v:.6g}" if abs(v) > 1e-12 else "0"
    return str(int(v)) if isinstance(v, (int, np.integer)) and not isinstance(v, (bool, np.bool_)) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))
