"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.rounding import round_half_up

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Final projection for the value check: rounded doubles, whole-second times as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = round_half_up(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.DateType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def comparable_sql(columns: dict[str, str], source: str, digits: int = 6) -> str:
    """SELECT list matching ``comparable``: column name to kind (i, d, s, b, t)."""
    out = []
    for name, kind in columns.items():
        c = f'"{name}"'
        expr = {
            "i": f"{c}::BIGINT", "d": f"round({c}::DOUBLE, {digits}) + 0.0", "s": f"{c}::VARCHAR",
            "b": c, "t": f"strftime({c}, '%Y-%m-%d %H:%M:%S')",
        }[kind]
        out.append(f"{expr} AS {c}")
    return f"SELECT {', '.join(out)} FROM {source}"
