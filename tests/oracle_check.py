"""Run every registered query against its SQL in DuckDB and report differences.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values comparable, rows in one order."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else str(v).replace(" 00:00:00", ""))
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(v).replace(" 00:00:00", "")).astype(object)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, otherwise what differs; floats must be identical."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = _plain(got), _plain(want)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind or (a[c].dtype.kind in "iuf" and a[c].dtype != b[c].dtype):
            return f"type of {c}: {a[c].dtype} != {b[c].dtype}"
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy())[0])
            return f"{int((~same).sum())} values of {c}, first {x[i]!r} != {y[i]!r} in row {dict(b.loc[i])}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from furrow.session import local_session

    queries, sql = entry.queries(), entry.oracle_sql()

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries)
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        got = queries[name](spark, sf_dir).toPandas()
        spent = time.time() - start
        if name not in sql:
            print(f"rows {name} {len(got)} {spent:.2f}s", flush=True)
            continue
        start = time.time()
        try:
            note = difference(got, con.sql(sql[name]).df())
        except duckdb.Error as error:
            note = f"sql failed: {error}"
        print(f"{'ok  ' if note is None else 'DIFF'} {name} {len(got)} {spent:.2f}s sql {time.time() - start:.2f}s {note or ''}", flush=True)
        bad += note is not None
    print(f"{bad} differ of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
