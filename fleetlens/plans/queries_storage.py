"""Registered queries that write tables below the session's shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetlens.functions import clock
from fleetlens.plans import domain
from fleetlens.plans.queries_feeds import _ORDER, payload_ticks, tick_log
from fleetlens.plans.queries_silver import MOVED, movement_steps
from fleetlens.plans.registry import comparable, comparable_sql, query
from fleetlens.plans.views_sql import with_views
from fleetlens.session import shared_folder, written
from fleetlens.sources import sinks, tables, ticks, versions
from fleetlens.streaming import feeds, keyed


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_EVENTS = "SELECT service_date AS date, trip_id, stop_sequence::BIGINT AS stop_sequence, event_type FROM stop_events"


def _events(spark, sf):
    return domain.stop_events(spark, sf).select(F.col("service_date").alias("date"), "trip_id", "stop_sequence", "event_type")


@query("k1_s2_dates_replaced", with_views(["stop_events"], f"SELECT date, trip_id, stop_sequence, CASE WHEN day(date::DATE) % 2 = 0 THEN 'again' ELSE event_type END AS event_type FROM ({_EVENTS}) WHERE date >= '2026-10-10'"))
def dates_replaced(spark, sf):
    path, rows = folder(spark, "k1"), _events(spark, sf)
    sinks.write_dates(rows, path)
    sinks.write_dates(rows.filter(F.dayofmonth(F.to_date("date")) % 2 == 0).withColumn("event_type", F.lit("again")), path, ["trip_id"])
    return comparable(tables.scan_days(spark, path, "2026-10-10"))


@query("k2_s1_appended_days", with_views(["stop_updates"], """SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, feed_timestamp, year(utc_at)::BIGINT AS year, month(utc_at)::BIGINT AS month, day(utc_at)::BIGINT AS day
 FROM (SELECT *, TIMESTAMP '1970-01-01' + to_seconds(feed_timestamp) AS utc_at FROM stop_updates)"""))
def appended_days(spark, sf):
    path, rows = folder(spark, "k2"), domain.stop_updates(spark, sf).select("trip_id", "stop_sequence", "feed_timestamp")
    for half in (0, 1):
        sinks.append_days(rows.filter(F.col("feed_timestamp") % 2 == half), path, clock.epoch_to_utc("feed_timestamp"))
    return comparable(tables.scan_raw(spark, path))


@query("k4_dataset", with_views(["stop_events"], _EVENTS))
def dataset(spark, sf):
    path = folder(spark, "k4")
    sinks.write_dataset(_events(spark, sf), path, ["date", "trip_id"])
    return comparable(spark.read.parquet(path))


@query("k5_report_files", with_views(["stop_events"], f"SELECT date, event_type, count(*) AS n FROM ({_EVENTS}) GROUP BY 1, 2"))
def report_files(spark, sf):
    report = _events(spark, sf).groupBy("date", "event_type").agg(F.count(F.lit(1)).alias("n"))
    csv, js = folder(spark, "k5"), folder(spark, "k5")
    sinks.write_report(report.filter("event_type = 'STOPPED'"), csv)
    sinks.write_report(report.filter("event_type <> 'STOPPED'"), js, "json")
    schema = "date string, event_type string, n long"
    return spark.read.schema(schema).option("header", True).csv(csv).unionByName(spark.read.schema(schema).json(js))


_TICKS = """SELECT event_id, source, strftime(to_timestamp(epoch)::TIMESTAMP, '%Y-%m-%d') AS date, strftime(to_timestamp(epoch)::TIMESTAMP, '%H') AS hour FROM (SELECT event_id, epoch, CASE WHEN user_id % 2 = 0 THEN 'um_tram' ELSE 'um_bus' END AS source FROM events_k)"""


def _dated_ticks(spark, sf):
    at = clock.epoch_to_utc("tick_ts")
    return payload_ticks(spark, sf).withColumns({"date": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")})


@query("k6_hours_materialized", with_views(["events_k"], f"SELECT event_id, source, date, hour AS hour_utc FROM ({_TICKS})"))
def hours_materialized(spark, sf):
    path, rows = folder(spark, "k6"), _dated_ticks(spark, sf).select("event_id", "source", "date", F.col("hour").alias("hour_utc"))
    early = rows.filter("hour_utc < '12'")
    versions.materialize_hours(spark, path, early, sinks.pending_hours(early, None))
    for _ in range(2):  # once more changes nothing
        versions.materialize_hours(spark, path, rows, sinks.pending_hours(rows, early))
    return versions.read(spark, path).select("event_id", "source", "date", "hour_utc")


@query("k3_versioned_upsert", with_views(["weather"], """SELECT station_name, strftime(b, '%Y-%m-%d %H:%M:%S') AS timestamp_bucket, max_by(temperature_c, (odd, t)) AS temperature_c
  FROM (SELECT *, "timestamp" AS t, date_trunc('hour', "timestamp") AS b, day("timestamp") % 2 = 1 AS odd FROM weather) GROUP BY 1, 2"""))
def versioned_upsert(spark, sf):
    """Even days, then odd days, then the odd days again, each a version of one table."""
    path = folder(spark, "k3")
    w = domain.weather(spark, sf).withColumn("timestamp_bucket", clock.hour_bucket(F.col("timestamp")))
    odd, keys = F.dayofmonth("timestamp") % 2 == 1, ["station_name", "timestamp_bucket"]
    for rows in (w.filter(~odd), w.filter(odd), w.filter(odd)):
        out = sinks.upsert(spark, path, rows, keys, [F.col("timestamp")])
    return comparable(out.select(*keys, "temperature_c"))


@query("k7_s13_compacted_ticks", with_views(["events_k"], f"SELECT event_id, source, date, CASE WHEN hour < '12' THEN '00' ELSE '12' END AS hour FROM ({_TICKS})"))
def compacted_ticks(spark, sf):
    loose, packed = folder(spark, "k7"), folder(spark, "k7")
    half = F.when(F.col("hour") < "12", "00").otherwise("12")
    rows = _dated_ticks(spark, sf).select("event_id", "payload", "source", "date", half.alias("hour"))
    rows.write.partitionBy("source", "date", "hour").parquet(loose)
    sinks.compact(spark, loose, packed, F.dayofmonth(F.to_date(F.col("date").cast("string"))) <= 15)
    read = lambda path: spark.read.schema(rows.schema).parquet(path)
    return ticks.preferred_ticks(read(packed), read(loose)).select("event_id", "source", "date", "hour")


@query("k8_tick_audit", with_views(["events_k"], """SELECT event_type AS source, epoch // 3600 * 3600 AS tick_ts, CASE WHEN k < 5 THEN 'TIMEOUT' WHEN k < 10 THEN 'EMPTY' ELSE 'OK' END AS status, length(props)::BIGINT AS bytes,
 day(TIMESTAMP '1970-01-01' + to_seconds(epoch // 3600 * 3600))::BIGINT AS day FROM events_k"""))
def tick_audit(spark, sf):
    path = folder(spark, "k8")
    sinks.append_days(tick_log(spark, sf).drop("recorded"), path, clock.epoch_to_utc("tick_ts"))
    return comparable(spark.read.parquet(path).select("source", "tick_ts", "status", "bytes", "day"))


@query("s3_timetable_text", with_views(["stop_times"], "SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, stop_id, arrival_time, departure_time FROM stop_times"))
def timetable_text(spark, sf):
    path = folder(spark, "s3")
    domain.stop_times(spark, sf).write.option("header", True).csv(f"{path}/stop_times.txt")
    return comparable(tables.timetable(spark, path, "stop_times").select("trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"))


@query("r1_changes_over_batches", with_views(["stop_updates"], f"""SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, feed_timestamp, rt_arrival_time FROM stop_updates
 QUALIFY lag(rt_arrival_time) OVER (PARTITION BY trip_id, stop_sequence ORDER BY {_ORDER}) IS DISTINCT FROM rt_arrival_time"""))
def changes_over_batches(spark, sf):
    """Three batches in time order, each with the state of the one before, give the changes of the whole."""
    rows, state, out = domain.stop_updates(spark, sf), None, None
    low, high = rows.agg(F.min("feed_timestamp"), F.max("feed_timestamp")).first()
    third = F.least(F.lit(2), F.floor((F.col("feed_timestamp") - low) * 3 / F.lit(max(1, high - low))))
    for i in range(3):
        found, state = feeds.changes(rows.filter(third == i), state, ttl_s=10**10, keep=lambda near: written(near, "changes"))
        out = found if out is None else out.unionByName(found)
    return comparable(out.select("trip_id", "stop_sequence", "feed_timestamp", "rt_arrival_time"))


def _streamed(rows, time: str, spark, name: str, make, parts: int = 3):
    """The output table of a stream that is run, stopped and started again as the rows arrive in ``parts`` lots in time order."""
    path = folder(spark, name)
    low, high = rows.agg(F.min(time), F.max(time)).first()
    part = F.least(F.lit(parts - 1), F.floor((F.col(time) - low) * parts / F.lit(max(1, high - low))))
    for i in range(parts):
        rows.filter(part == i).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        out = keyed.to_table(make(stream), f"{path}/out", f"{path}/checkpoint")
    return out


#: Longer than any span of the views, so that nothing expires and a stream must give what one batch gives.
FOREVER_S = 10**8


@query("r1_r2_streamed_changes", with_views(["stop_updates"], f"""SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, feed_timestamp, rt_arrival_time FROM stop_updates
 QUALIFY lag(rt_arrival_time) OVER (PARTITION BY trip_id, stop_sequence ORDER BY {_ORDER}) IS DISTINCT FROM rt_arrival_time"""))
def streamed_changes(spark, sf):
    out = _streamed(domain.stop_updates(spark, sf), "feed_timestamp", spark, "r1", lambda s: keyed.changes(s, ttl_s=FOREVER_S))
    return comparable(out.select("trip_id", "stop_sequence", "feed_timestamp", "rt_arrival_time"))


@query("r5_streamed_latest_forecasts", with_views(["stop_updates"], "SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, max(feed_timestamp) AS tick_ts FROM stop_updates GROUP BY 1, 2"))
def streamed_latest(spark, sf):
    u = domain.stop_updates(spark, sf).select("trip_id", "stop_sequence", F.col("feed_timestamp").alias("tick_ts"), F.col("arrival_delay_seconds").alias("forecast_val"))
    out = _streamed(u.withColumn("hour_utc", F.floor(F.col("tick_ts") / F.lit(3600))), "tick_ts", spark, "r5", lambda s: keyed.latest_forecasts(s, ttl_s=FOREVER_S))
    return comparable(out.groupBy("trip_id", "stop_sequence").agg(F.max("tick_ts").alias("tick_ts")))


@query("r8_streamed_movement", with_views(["raw_pings"], comparable_sql({k: v for k, v in MOVED.items() if k != "n_ticks_seen"}, "moved"), movement_steps("raw_pings")))
def streamed_movement(spark, sf):
    """A run of pings that goes on in the next file keeps its first fix, so only its count of ticks is that of its file."""
    out = _streamed(domain.raw_pings(spark, sf), "tick_ts", spark, "r8", lambda s: keyed.moving_fixes(s, ttl_s=FOREVER_S))
    return comparable(out.select(*[c for c in MOVED if c != "n_ticks_seen"]))
