"""Compare a query with its SQL: same columns, same rows, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dict):
        return tuple(sorted((str(k), _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return value


def rows_of_spark(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list]:
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    names = sorted(cols)
    place = [cols.index(n) for n in names]
    return names, sorted((tuple(_plain(r[i]) for i in place) for r in cur.fetchall()), key=repr)
