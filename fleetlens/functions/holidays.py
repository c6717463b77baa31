"""Calendar dimension: Easter, statutory holidays and school days as column expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Statutory holidays on fixed dates (month, day).
FIXED_HOLIDAYS = [(1, 1), (1, 6), (5, 1), (5, 3), (8, 15), (11, 1), (11, 11), (12, 25), (12, 26)]
# Statutory holidays as days after Easter Sunday.
MOVABLE_HOLIDAYS = [0, 1, 49, 60]
# Regional winter school breaks, first and last day.
WINTER_BREAKS = [
    ("2024-01-15", "2024-01-28"),
    ("2025-02-03", "2025-02-16"),
    ("2026-01-19", "2026-02-01"),
    ("2027-01-18", "2027-01-31"),
]


# Gregorian Easter by the epact: the full moon date from the golden number, then next Sunday.
_EPACT = "(y div 100 - y div 400 - (8 * (y div 100) + 13) div 25 + 19 * (y % 19) + 15) % 30"
_MOON = "epact - if(epact = 29 or (epact = 28 and y % 19 > 10), 1, 0)"
_EASTER = "date_add(make_date(y, 3, 28), moon - cast((y + y div 4 + moon + 2 - y div 100 + y div 400) % 7 as int))"


def with_easter(df: DataFrame, day: str = "day", name: str = "easter") -> DataFrame:
    """Add Easter Sunday of the year of ``day``."""
    staged = df.withColumn("y", F.year(day)).withColumn("epact", F.expr(_EPACT).cast("int"))
    return staged.withColumn("moon", F.expr(_MOON)).withColumn(name, F.expr(_EASTER)).drop("y", "epact", "moon")


def is_holiday(day: str, easter: str) -> Column:
    """Holiday test; ``day`` and ``easter`` are SQL expressions of the same year."""
    fixed = " or ".join(f"(month({day}) = {m} and day({day}) = {d})" for m, d in FIXED_HOLIDAYS)
    return F.expr(f"{fixed} or datediff({day}, {easter}) in ({', '.join(map(str, MOVABLE_HOLIDAYS))})")


def is_free_of_school(day: str, easter: str) -> Column:
    """Free days that are not public holidays."""
    winter = " or ".join(f"{day} between date'{a}' and date'{b}'" for a, b in WINTER_BREAKS)
    return F.expr(
        f"dayofweek({day}) in (1, 7) or month({day}) in (7, 8) or (month({day}) = 6 and day({day}) >= 25)"
        f" or (month({day}) = 12 and day({day}) >= 23) or (month({day}) = 10 and day({day}) = 14)"
        f" or datediff({day}, {easter}) between -3 and 2 or {winter}")


def calendar_flags(days: DataFrame, day: str = "day") -> DataFrame:
    """Flags for a column of dates. Each day is judged on its own: no join, no sort.

    The eve test needs no other year's Easter: 31 December precedes a fixed holiday.
    """
    rows = with_easter(days.select(F.col(day).alias("day")))
    holiday = is_holiday("day", "easter")
    return rows.select(
        F.col("day").cast("string").alias("calendar_date"),
        (~(holiday | is_free_of_school("day", "easter"))).cast("int").alias("is_school_day"),
        holiday.cast("int").alias("is_public_holiday"),
        (F.expr("dayofweek(day) between 2 and 6") & is_holiday("date_add(day, 1)", "easter")).cast("int").alias("is_holiday_eve"),
    )


def calendar_dimension(spark: SparkSession, start: str = "2024-01-01", end: str = "2027-12-31") -> DataFrame:
    first, last = (datetime.date.fromisoformat(x[:10]) for x in (start, end))
    span = F.sequence(F.lit(first), F.lit(last))
    return calendar_flags(spark.range(1).select(F.explode(span).alias("day")))
