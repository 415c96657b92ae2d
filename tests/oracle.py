"""Order-insensitive comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Spark type name -> DuckDB types that carry the same values.
SAME_TYPES = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
    "timestamp": {"TIMESTAMP"},
    "timestamp_ntz": {"TIMESTAMP"},
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(frame, con, sql: str) -> list[str]:
    """Human-readable mismatches; empty when both sides agree."""
    cursor = con.execute(sql)
    sql_types = {d[0]: str(d[1]).upper() for d in cursor.description}
    expected = cursor.fetchall()
    found = []
    spark_types = dict(frame.dtypes)
    if sorted(spark_types) != sorted(sql_types):
        return [f"columns {sorted(spark_types)} != {sorted(sql_types)}"]
    for name, kind in spark_types.items():
        real = {"NUMBER": "?"}.get(sql_types[name], sql_types[name])
        if real not in SAME_TYPES.get(kind, {real}):
            found.append(f"type of {name}: spark {kind}, sql {real}")
    rows = frame.collect()
    left = _rows(frame.columns, rows)
    right = _rows(list(sql_types), expected)
    if left != right:
        found.append(
            f"rows {sum(left.values())} != {sum(right.values())}" if len(rows) != len(expected)
            else "values differ"
        )
        found.append(f"only spark: {list((left - right).items())[:3]}")
        found.append(f"only sql:   {list((right - left).items())[:3]}")
    return found
