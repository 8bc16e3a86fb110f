"""Runs a query and its SQL over the same tables and compares rows as the driver does: columns by name, rows as a bag."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    left = bag(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    right = bag([d[0] for d in found.description], found.fetchall())
    assert left[0] == right[0]
    assert left[1] == right[1], f"only in Spark: {list((left[1] - right[1]).items())[:3]}; only in SQL: {list((right[1] - left[1]).items())[:3]}"


def types(spark, con, query, sql: str, sf_dir: str) -> tuple[dict, dict]:
    """Column types of both sides in one spelling."""
    names = {"INTEGER": "int", "BIGINT": "bigint", "HUGEINT": "hugeint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}
    left = dict(query(spark, sf_dir).dtypes)
    right = {r[0]: names.get(r[1], r[1].lower()) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return left, right
