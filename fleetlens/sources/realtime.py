"""Decoded real-time feed rows: flattening, live filter, full delay records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import clock

EVENT = "struct<delay: int, time: bigint>"
STOP_UPDATE = f"struct<stop_sequence: int, stop_id: string, arrival: {EVENT}, departure: {EVENT}>"
# Feed rows: feed_timestamp, trip (trip_id, route_id, start_date, start_time, relationship), vehicle_id,
# stops array<STOP_UPDATE>, has_position, has_alert.


def _updates(feed: DataFrame) -> DataFrame:
    return feed.select("*", F.explode("stops").alias("u"))


def forecasts(feed: DataFrame) -> DataFrame:
    """(trip_id, stop_sequence, kind, value): arrival before departure, delay before time."""
    source = F.when(F.col("u.arrival").isNotNull(), F.col("u.arrival")).otherwise(F.col("u.departure"))
    rows = _updates(feed.filter(F.coalesce("trip.trip_id", F.lit("")) != "")).withColumn("e", source)
    kind = F.when(F.col("e.delay").isNotNull(), "delay").when(F.col("e.time").isNotNull(), "time")
    value = F.coalesce(F.col("e.delay").cast("long"), F.col("e.time"))
    return rows.select("feed_timestamp", F.col("trip.trip_id").alias("trip_id"), F.col("u.stop_sequence").alias("stop_sequence"),
                       kind.alias("forecast_kind"), value.alias("forecast_val")).filter("forecast_kind is not null")


def live_entities(feed: DataFrame) -> DataFrame:
    """Entities of trips with a vehicle position, with any non-zero delay, or modified; alerts stay."""
    active = feed.filter("has_position").select(F.col("trip.trip_id").alias("__t")).distinct()
    moved = F.exists("stops", lambda u: (F.coalesce(u["arrival"]["delay"], F.lit(0)) != 0) | (F.coalesce(u["departure"]["delay"], F.lit(0)) != 0))
    modified = F.coalesce(F.col("trip.relationship"), F.lit(0)) != 0
    joined = feed.join(active, F.col("trip.trip_id") == F.col("__t"), "left")
    keep = F.col("__t").isNotNull() | F.coalesce(moved, F.lit(False)) | modified | F.coalesce("has_alert", F.lit(False))
    return joined.filter(keep).drop("__t")


def delay_records(feed: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """Full delay records with defaults; a missing delay is derived from the schedule when it is known.

    ``schedule``: trip_id, stop_sequence, stop_id, route_id, arrival_time, departure_time (text).
    """
    local_day = F.to_date(clock.epoch_to_local("feed_timestamp"))
    rows = _updates(feed).select(
        "feed_timestamp", F.col("trip.trip_id").alias("trip_id"), F.col("trip.route_id").alias("f_route"),
        F.coalesce("trip.start_date", F.date_format(local_day, "yyyyMMdd")).alias("start_date"),
        F.coalesce("trip.start_time", F.lit("")).alias("start_time"), F.coalesce("vehicle_id", F.lit("")).alias("vehicle_id"),
        F.col("u.stop_sequence").alias("stop_sequence"), F.col("u.stop_id").alias("f_stop"),
        F.col("u.arrival.delay").alias("arr"), F.col("u.departure.delay").alias("dep"),
        F.col("u.arrival.time").alias("rt_arrival_time"), F.col("u.departure.time").alias("rt_departure_time"),
        clock.local_to_epoch(local_day.cast("timestamp_ntz")).alias("midnight"))
    if schedule is None:
        for c in ("route_id", "stop_id", "arrival_time", "departure_time"):
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    else:
        rows = rows.join(schedule.select("trip_id", "stop_sequence", "stop_id", "route_id", "arrival_time", "departure_time"),
                         ["trip_id", "stop_sequence"], "left")

    def delay(direct: str, actual: str, planned: str) -> Column:
        derived = F.col(actual) - (F.col("midnight") + clock.timetable_seconds(planned, None))
        return F.coalesce(F.col(direct), derived.cast("int"))

    return rows.select(
        "feed_timestamp", "trip_id", F.coalesce(F.nullif(F.col("f_route"), F.lit("")), F.col("route_id"), F.lit("")).alias("route_id"),
        "start_date", "start_time", "vehicle_id", "stop_sequence",
        F.coalesce(F.nullif(F.col("f_stop"), F.lit("")), F.col("stop_id"), F.lit("")).alias("stop_id"),
        delay("arr", "rt_arrival_time", "arrival_time").alias("arrival_delay_seconds"),
        delay("dep", "rt_departure_time", "departure_time").alias("departure_delay_seconds"),
        "rt_arrival_time", "rt_departure_time")
