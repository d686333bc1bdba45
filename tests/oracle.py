"""Runs a registered query and its SQL twin and compares them as multisets of rows."""

from __future__ import annotations

import collections
import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), _cell(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a description of the difference."""
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    want = rows_of(want_columns, cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    missing, extra = want - got, got - want
    return (
        f"spark {sum(got.values())} rows, sql {sum(want.values())}; only sql {sum(missing.values())}, only spark {sum(extra.values())}\n"
        f"  sql:   {[str(r)[:600] for r in list(missing)[:2]]}\n  spark: {[str(r)[:600] for r in list(extra)[:2]]}"
    )
