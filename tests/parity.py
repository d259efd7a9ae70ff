"""Side-by-side comparison of a query with its SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _cell(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, int) and not isinstance(x, bool):
        return float(x)
    return x


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_cell(r[n]) for n in names) for r in df.collect())


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in got.fetchall())


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows, repeated rows included."""
    a, b = spark_rows(df), sql_rows(sql, sf_dir)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    more, less = a[1] - b[1], b[1] - a[1]
    return f"{sum(more.values())} rows only in Spark, {sum(less.values())} only in SQL: {list(more)[:3]} {list(less)[:3]}" if more or less else ""
