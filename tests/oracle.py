"""Compare registered queries with their SQL on the given tables."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

from prismill.plans.registry import ORACLES, QUERIES, TABLES


def connection(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0
    if isinstance(value, bool):
        return value
    return value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def _kind(value):
    return "number" if isinstance(value, float) else type(value).__name__


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = QUERIES[name](spark, folder)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = _rows(cursor.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}\n  got  {got[:3]}\n  want {want[:3]}"
    columns = sorted(names)
    for a, b in zip(got, want):
        for column, x, y in zip(columns, a, b):
            if x is None and y is None:
                continue
            if x != y or _kind(x) != _kind(y):
                return f"{column}: {x!r} ({_kind(x)}) != {y!r} ({_kind(y)})\n  got  {a}\n  want {b}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__  # noqa: F401  registers the queries
    from prismill.session import local_session

    spark = local_session("oracle", 8)
    con = connection(folder)
    bad = 0
    names = [n for n in QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, folder, name)
            else:
                df = QUERIES[name](spark, folder)
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - start
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {took:6.2f}s {'S' if name in ORACLES else 'R'} {name} {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
