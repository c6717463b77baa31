"""Readers of partitioned tables and timetable text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Timetable tables and the numeric columns read from their text.
TIMETABLE = {
    "trips": {}, "stop_times": {"stop_sequence": "int"}, "stops": {"stop_lat": "double", "stop_lon": "double"},
    "shapes": {"shape_pt_lat": "double", "shape_pt_lon": "double", "shape_pt_sequence": "int"},
    "calendar_dates": {"exception_type": "int"},
    "calendar": {d: "int" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")},
}


def scan_raw(spark: SparkSession, base: str, view: str | None = None) -> DataFrame:
    """Raw delay store partitioned by year, month, day; optionally registered as a view."""
    rows = spark.read.parquet(base)
    if view:
        rows.createOrReplaceTempView(view)
    return rows


def scan_days(spark: SparkSession, base: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Date-partitioned dataset with bounds on the partition column, so other days are not listed."""
    rows = spark.read.parquet(base)
    if start:
        rows = rows.filter(F.col("date") >= F.lit(start[:10]).cast(rows.schema["date"].dataType))
    if end:
        rows = rows.filter(F.col("date") <= F.lit(end[:10]).cast(rows.schema["date"].dataType))
    return rows


def timetable(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One timetable file: every column text, then the numeric ones cast; bad numbers become null."""
    rows = spark.read.option("header", True).csv(f"{folder}/{table}.txt")
    casts = {c: F.col(c).try_cast(t) for c, t in TIMETABLE.get(table, {}).items() if c in rows.columns}
    return rows.withColumns(casts) if casts else rows


def days_to_build(inputs: DataFrame, outputs: DataFrame | None, force: bool = False) -> DataFrame:
    """Dates present in the input but not in the output; all of them when forced."""
    have = inputs.select("date").distinct()
    if force or outputs is None:
        return have
    return have.join(outputs.select("date").distinct(), "date", "left_anti")


