"""Order-insensitive comparison of a Spark result with DuckDB's over the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    rows = [tuple(None if v is None else float(v) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v for v in r) for r in df.itertuples(index=False)]
    return pd.DataFrame(sorted(rows, key=repr), columns=sorted(df.columns), dtype=object)


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty if equal, else what differs."""
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    a, b = canonical(mine), canonical(theirs)
    for (_, x), (_, y) in zip(a.iterrows(), b.iterrows()):
        if tuple(x) != tuple(y):
            return f"{tuple(x)} and {tuple(y)}"
    return ""
