"""Runs a query in Spark and its SQL in DuckDB and compares whole results."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, Decimal):
        return f"DECIMAL {value}"
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, bool):
        return value
    return value


def kind(value) -> str:
    return type(value).__name__


def differences(df, con: duckdb.DuckDBPyConnection, sql: str, limit: int = 5) -> list[str]:
    columns = sorted(df.columns)
    spark_rows = [tuple(_norm(row[c]) for c in columns) for row in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return [f"columns: spark {columns} sql {sorted(names)}"]
    index = [names.index(c) for c in columns]
    sql_rows = [tuple(_norm(row[i]) for i in index) for row in result.fetchall()]
    out = []
    if len(spark_rows) != len(sql_rows):
        out.append(f"rows: spark {len(spark_rows)} sql {len(sql_rows)}")
    a, b = Counter(map(repr, spark_rows)), Counter(map(repr, sql_rows))
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    if only_a or only_b:
        out.append(f"{len(only_a)} only in spark, {len(only_b)} only in sql; columns {columns}")
        out += [f"  spark {r}" for r in sorted(only_a)[:limit]] + [f"  sql   {r}" for r in sorted(only_b)[:limit]]
    if not spark_rows:
        out.append("EMPTY")
    return out
