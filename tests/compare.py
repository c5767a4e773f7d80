"""Run registered queries in Spark and their SQL in DuckDB, and compare all values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql) -> str | None:
    """None if equal, else what differs."""
    ours_names, ours = _rows(df.columns, df.collect())
    result = con.execute(sql)
    names, theirs = _rows([d[0] for d in result.description], result.fetchall())
    if ours_names != names:
        return f"columns {ours_names} / {names}"
    if ours != theirs:
        return f"rows {sum(ours.values())} / {sum(theirs.values())}: {list((ours - theirs).items())[:3]} / {list((theirs - ours).items())[:3]}"
    return None
