"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import math

import duckdb

from keyweave.workload.tables import NAMES


def connect(folder: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _sorted(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), str(v)) for v in row])


def spark_rows(df):
    names = sorted(df.columns)
    return names, _sorted(tuple(_cell(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())


def sql_rows(con, sql: str):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], _sorted(tuple(_cell(row[i]) for i in order) for row in result.fetchall())


SPARK_TO_SQL = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def types_differ(df, con, sql: str) -> list[str]:
    described = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{f.name}: {f.dataType.simpleString()} / {described.get(f.name)}"
        for f in df.schema
        if SPARK_TO_SQL.get(f.dataType.simpleString()) != described.get(f.name)
    ]
