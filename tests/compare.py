"""Compare a Spark result with the DuckDB result of its oracle statement."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=_key)


def differences(df, con, sql: str) -> list[str]:
    """Everything that differs: columns, types, row count, values. Empty when equal."""
    cursor = con.execute(sql)
    duck_names = [d[0] for d in cursor.description]
    duck_types = {d[0]: str(d[1]) for d in cursor.description}
    duck_rows = cursor.fetchall()
    spark_names = df.columns
    if sorted(spark_names) != sorted(duck_names):
        return [f"columns {sorted(spark_names)} != {sorted(duck_names)}"]
    out = []
    for name, kind in df.dtypes:
        if SPARK_TO_DUCK.get(kind, kind) != duck_types[name]:
            out.append(f"type of {name}: {kind} != {duck_types[name]}")
    ours, theirs = rows_of(spark_names, df.collect()), rows_of(duck_names, duck_rows)
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} != {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}")
    return out
