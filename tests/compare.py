"""Runs a query and its SQL on the same tables and reports differences."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return x + 0.0
    if isinstance(x, dt.datetime):
        return x.isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=lambda t: [(x is None, str(x)) for x in t])


# Spark type to the SQL type that holds the same values
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def type_differences(df, con, sql: str) -> list[str]:
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{name}: {kind} / {theirs.get(name)}"
        for name, kind in df.dtypes
        if KINDS.get(kind) != theirs.get(name)
    ]


def differences(df, con, sql: str, show: int = 5) -> list[str]:
    """Empty if names, row count and every value agree exactly."""
    mine = _rows(df.columns, [tuple(x) for x in df.collect()])
    result = con.execute(sql)
    theirs = _rows([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} / {theirs[0]}"]
    if len(mine[1]) != len(theirs[1]):
        return [f"rows {len(mine[1])} / {len(theirs[1])}"]
    bad = [f"{a} / {b}" for a, b in zip(mine[1], theirs[1]) if a != b]
    return [f"{len(bad)} rows differ", *bad[:show]] if bad else []
