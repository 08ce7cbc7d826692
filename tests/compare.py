"""Compare registered queries with their SQL on one data folder: `python tests/compare.py [sf] [prefix ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def normalized(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, all values as text of one form, rows sorted."""
    out = frame[sorted(frame.columns)].copy()
    for column in out.columns:
        values = out[column]
        if pd.api.types.is_bool_dtype(values):
            out[column] = values.map(str)
        elif pd.api.types.is_numeric_dtype(values):
            out[column] = values.astype("float64").round(6).map(lambda x: "null" if pd.isna(x) else repr(x + 0.0))
        elif pd.api.types.is_datetime64_any_dtype(values):
            out[column] = values.astype("datetime64[us]").astype(str)
        else:
            out[column] = values.map(lambda x: "null" if x is None or x is pd.NA or x != x else str(x))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def difference(found: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    """None if both hold the same rows, else a short description."""
    if sorted(found.columns) != sorted(wanted.columns):
        return f"columns {sorted(found.columns)} != {sorted(wanted.columns)}"
    if len(found) != len(wanted):
        return f"{len(found)} rows != {len(wanted)}"
    left, right = normalized(found), normalized(wanted)
    if not left.equals(right):
        mask = (left != right).any(axis=1)
        return f"{int(mask.sum())} rows differ, e.g.\n{left[mask].head(3)}\n{right[mask].head(3)}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    from sessiongraph.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failures = connect(sf_dir), oracle_sql(), []
    for name, run in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            found = run(spark, sf_dir).toPandas()
            problem = "no rows" if name not in oracles and found.empty else None
            spent = time.time() - started
            if name in oracles:
                started = time.time()
                problem = difference(found, connection.sql(oracles[name]).df())
                print(f"{name}: {len(found)} rows, {spent:.1f}s, sql {time.time() - started:.1f}s", flush=True)
            else:
                print(f"{name}: {len(found)} rows, {spent:.1f}s, no sql", flush=True)
        except Exception as error:  # noqa: BLE001  (report and go on)
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem:
            failures.append(name)
            print(f"FAILED {name}: {problem}", flush=True)
    print(f"{len(failures)} failed: {failures}")


if __name__ == "__main__":
    main()
