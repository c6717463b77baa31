"""Domain rules on routes, hours, weather and stop names."""

from __future__ import annotations

import datetime
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions import clock


def route_number(route: Column) -> Column:
    return route.try_cast("int")


def is_tram(route: Column, vehicle_type: Column | None = None) -> Column:
    by_number = F.coalesce(route_number(route) < 100, F.lit(False))
    if vehicle_type is not None:
        by_number = F.coalesce(vehicle_type == "tram", F.lit(False)) | by_number
    return by_number.cast("int")


def cohort(route: Column, vehicle_type: Column | None = None) -> Column:
    n = route_number(route)
    tram = n.between(1, 79)
    if vehicle_type is not None:
        tram = (vehicle_type == "tram") | tram
    return (
        F.when(tram, "urban_tram")
        .when(n.between(100, 599), "urban_bus")
        .when(n.between(700, 899) | F.upper(route).startswith("L"), "suburban_bus")
        .when(F.upper(route).startswith("N"), "night_bus")
        .otherwise("other")
    )


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def calendar_columns(local: Column) -> dict[str, Column]:
    """Hour, weekday (0 = Sunday), weekend and peak flags of a local timestamp."""
    hour = F.hour(local)
    weekday = clock.weekday_sunday0(local)
    morning, evening = hour.between(7, 9), hour.between(16, 18)
    return {
        "arrival_ts": local,
        "timestamp_bucket": clock.hour_bucket(local),
        "hour_of_day": hour,
        "day_of_week": weekday,
        "is_weekend": flag(weekday.isin(0, 6)),
        "is_peak_hour": flag(morning | evening),
        "is_morning_peak": flag(morning),
        "is_evening_peak": flag(evening),
    }


def rain_category(mm: Column) -> Column:
    return F.when(mm == 0, 0).when(mm <= 0.5, 1).when(mm <= 1.5, 2).otherwise(3)


# Accented letters and their plain forms.
_ACCENTED = "ąćęłńóśźż"
_PLAIN = "acelnoszz"


def normalize_name(name: Column) -> Column:
    folded = F.translate(F.lower(F.coalesce(name, F.lit(""))), _ACCENTED, _PLAIN)
    return F.regexp_replace(folded, "[^a-z0-9]", "")


def _bound(text: str | None) -> datetime.datetime | None:
    text = (text or "").strip()
    return datetime.datetime.fromisoformat(text) if text else None


def check_range(start: str | None, end: str | None) -> tuple[str, str]:
    """Stripped bounds; unreadable or inverted ones are rejected."""
    lo, hi = _bound(start), _bound(end)
    if lo and hi and lo > hi:
        raise ValueError(f"start {start} lies after end {end}")
    return (start or "").strip(), (end or "").strip()


def local_range(
    col: Column,
    start: str | None = None,
    end: str | None = None,
    epoch_seconds: bool = True,
    zone: str = clock.CITY_ZONE,
) -> Column:
    """Local-time range test. Ten-character bounds compare whole days (end inclusive); longer
    bounds compare wall-clock instants; without bounds every row passes.

    On an epoch column a day bound becomes a plain integer comparison, so it reaches the
    Parquet scan; a wall-clock bound adds a one-hour-wide integer bound for the same reason.
    """
    start, end = check_range(start, end)
    tz = zoneinfo.ZoneInfo(zone)
    local = clock.epoch_to_local(col, zone) if epoch_seconds else col.cast("timestamp_ntz")
    test = F.lit(True)
    for text, low in ((start, True), (end, False)):
        if not text:
            continue
        at = _bound(text)
        whole_day = len(text) == 10
        if epoch_seconds and whole_day:
            edge = at if low else at + datetime.timedelta(days=1)
            epoch = int(edge.replace(tzinfo=tz).timestamp())
            test = test & ((col >= epoch) if low else (col < epoch))
            continue
        if whole_day:
            edge = at if low else at + datetime.timedelta(days=1)
            right = F.lit(edge.isoformat(sep=" ")).cast("timestamp_ntz")
            test = test & ((local >= right) if low else (local < right))
            continue
        right = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
        test = test & ((local >= right) if low else (local <= right))
        if epoch_seconds:
            near = int(at.replace(tzinfo=tz).timestamp())
            test = test & ((col >= near - 3600) if low else (col <= near + 3600))
    return test


def seeded_order(key: Column, seed: int) -> Column:
    """Repeatable pseudo-random order that other engines can reproduce."""
    return F.md5(F.concat(key, F.lit(f"_{seed}")))
