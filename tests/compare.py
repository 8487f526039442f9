"""Holds a query's rows against its SQL's rows, run by DuckDB on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path
from typing import Any

import duckdb


def plain(v: Any) -> Any:
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 4)
    return v if isinstance(v, (int, str)) else str(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def difference(rows: list, columns: list[str], con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both sides have the same columns and rows."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} and {sorted(names)}"
    order = sorted(names)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in rows)
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
