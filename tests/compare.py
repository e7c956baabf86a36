"""Run queries against their SQL on the same Parquet files."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def _family(type_name: str) -> str:
    name = type_name.lower()
    if name in ("tinyint", "smallint", "int", "integer", "bigint", "long", "hugeint"):
        return "integer" if name != "hugeint" else "hugeint"
    return {"varchar": "string", "double": "double"}.get(name, name)


def difference(spark_result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    expected = con.execute(sql)
    names = [c[0] for c in expected.description]
    types = {c[0]: _family(str(c[1])) for c in expected.description}
    want = _rows(names, expected.fetchall())
    if sorted(names) != sorted(spark_result.columns):
        return f"columns {sorted(spark_result.columns)} instead of {sorted(names)}"
    got_types = {f.name: _family(f.dataType.simpleString()) for f in spark_result.schema.fields}
    if types != got_types:
        return "types " + str({n: (got_types[n], types[n]) for n in names if got_types[n] != types[n]})
    got = _rows(spark_result.columns, spark_result.collect())
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return f"row {mine} instead of {theirs}"
    return None
