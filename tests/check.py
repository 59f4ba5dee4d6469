"""Compare registered queries with their SQL twins: python tests/check.py [names] [--sf DIR] [--blocks N] [--small N]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    exact = [c for c in df.columns if not pd.api.types.is_float_dtype(df[c])]
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    order = exact + [c for c in df.columns if c not in exact]
    return df.sort_values(order, na_position="first").reset_index(drop=True)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> list[str]:
    """Empty when both frames hold the same rows."""
    if sorted(left.columns) != sorted(right.columns):
        return [f"columns {sorted(left.columns)} vs {sorted(right.columns)}"]
    if len(left) != len(right):
        return [f"rows {len(left)} vs {len(right)}"]
    a, b = normal(left), normal(right)
    out = []
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        else:
            bad = ~((a[c].astype(object) == b[c].astype(object)) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            out.append(f"{c}: {int(bad.sum())} of {len(a)} differ, first {a[c][i]!r} vs {b[c][i]!r}")
    return out


def main() -> int:
    import __spark_entry__ as entry
    from serieswise.session import local_session

    args = [a for a in sys.argv[1:]]
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf_dir = args[i + 1]
        del args[i : i + 2]
    spark = local_session(8)
    for flag, setting in (("--blocks", "serieswise.blockRows"), ("--small", "serieswise.smallGroup")):
        if flag in args:
            i = args.index(flag)
            spark.conf.set(setting, args[i + 1])
            del args[i : i + 2]
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    chosen = [q for q in queries if not args or any(q == a or (a.endswith("*") and q.startswith(a[:-1])) for a in args)]
    failed = []
    for name in chosen:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracles:
                want = con.execute(oracles[name]).df()
                diff = differences(got, want)
            else:
                diff = [] if len(got) else ["no rows"]
        except Exception as err:  # report and go on
            took, got, diff = time.time() - start, [], [f"{type(err).__name__}: {str(err)[:600]}"]
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if diff else 'ok':4} {name:28} {kind:4} {len(got):7d} rows {took:6.2f}s", *diff, sep=" ", flush=True)
        if diff:
            failed.append(name)
    print(f"{len(chosen) - len(failed)} of {len(chosen)} pass; failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
