"""Compare every query with its SQL on one scale: ``python tests/compare.py sf0.01 [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(folder: str, text: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con.execute(text).df()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else v)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = canonical(left), canonical(right)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and not pd.api.types.is_bool_dtype(a[c]):
            same = np.isclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=0, equal_nan=True)
        else:
            same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not np.all(same):
            at = int(np.flatnonzero(~np.asarray(same, dtype=bool))[0])
            return f"{int((~np.asarray(same, dtype=bool)).sum())} values of {c} differ, first {a.loc[at].to_dict()} / {b.loc[at].to_dict()}"
    return ""


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from cellweave.session import local_session

    folder = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:] or list(queries())
    spark = local_session("8")
    oracle, bad = oracle_sql(), []
    for name in wanted:
        start = time.time()
        try:
            df = queries()[name](spark, folder)
            types = dict(df.dtypes)
            got = df.toPandas()
            took = time.time() - start
            if name in oracle:
                expected = run_sql(folder, oracle[name])
                problem = differences(got, expected)
            else:
                problem = "" if len(got) else "no rows"
        except Exception as error:  # noqa: BLE001
            problem, took, got, types = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start, [], {}
        kind = "sql" if name in oracle else "rows"
        print(f"{'ok  ' if not problem else 'FAIL'} {name:26s} {kind} {len(got):7d} rows {took:6.2f}s {problem}", flush=True)
        bad += [name] if problem else []
    print("failed:", bad)


if __name__ == "__main__":
    main()
