"""Runs a query beside its DuckDB SQL and compares the rows, in any order."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x: object) -> object:
    if x is None or isinstance(x, (str, bool)):
        return x
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    x = float(x)
    return "nan" if math.isnan(x) else x + 0.0  # every digit that a query returns counts


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def both(spark: SparkSession, con: duckdb.DuckDBPyConnection, made: object, sql: str, sf_dir: str) -> tuple[tuple, tuple]:
    df = made(spark, sf_dir)
    theirs = con.sql(sql)
    return (sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])), (sorted(theirs.columns), rows_of(theirs.columns, theirs.fetchall()))
