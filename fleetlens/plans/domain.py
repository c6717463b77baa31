"""Transit views over the benchmark tables.

The given tables are not transit data, so each view maps them onto the transit schemas with
plain column arithmetic. Every view keeps one row per source row (or a fixed expansion of it),
so work grows with the tables. ``views_sql`` holds the same views as SQL for the oracle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.operators.latest import latest_per_key
from fleetlens.plans.mart import Dimensions
from fleetlens.session import proportioned, stored

# Days used by the views: service days cover four weeks around the autumn clock change.
FIRST_DAY = "2026-10-05"
N_DAYS = 28
FIRST_DAY_EPOCH = 1791158400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return proportioned(spark.read.parquet(f"{sf}/{name}.parquet"))


def kept(view):
    """Keep a derived view as a stored table, as the layers before it would be in production; ``.view`` is the view itself.

    A query that needs few of its columns, or goes on along its trips, takes the view: the rest is not computed, written or shuffled again.
    """

    @functools.wraps(view)
    def read(spark: SparkSession, sf: str) -> DataFrame:
        return stored(spark, f"{view.__name__}_{sf}", lambda: view(spark, sf))

    read.view = view
    return read


def _t(n: Column) -> Column:
    return n.cast("string")


def _route(r: Column) -> Column:
    return (
        F.when(r < 6, _t(r + 1))
        .when(r < 18, _t(100 + r * 7))
        .when(r < 22, _t(700 + r))
        .when(r < 25, F.concat(F.lit("L"), _t(r)))
        .when(r < 28, F.concat(F.lit("N"), _t(r)))
        .otherwise(_t(900 + r))
    )


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: a trip with route, day, vehicle and start time."""
    r = F.col("o_custkey") % 30
    day = F.pmod(F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")), F.lit(N_DAYS)).cast("long")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trip_no"),
        F.concat(F.lit("T"), _t(F.col("o_orderkey"))).alias("trip_id"),
        r.alias("r"),
        _route(r).alias("route_id"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")).cast("string").alias("service_date"),
        _t(F.col("o_orderkey") % 3 + 1).alias("brigade"),
        F.concat(F.lit("V"), _t(F.col("o_orderkey") % 250)).alias("vehicle_id"),
        F.when(r < 6, "tram").otherwise("bus").alias("vehicle_type"),
        (F.lit(18000).cast("long") + (F.col("o_orderkey") * 7) % 80 * 900).alias("start_sec"),
        (F.lit(FIRST_DAY_EPOCH).cast("long") + day * 86400 - 7200).alias("day_epoch"),
        (F.col("o_orderstatus") == "P").alias("day_unknown"),
    )


def _line_values(lines: DataFrame) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    noise = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + q * 11) % 420 - 90
    late = F.when(F.col("l_partkey") % 89 == 0, 8000).when(F.col("l_suppkey") % 17 == 0, 700).otherwise(0)
    return lines.withColumns({"q": q, "delay": (noise + late).cast("int")})


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus"]


@kept
def stop_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted delays: one row per order line, repeats of a (trip, stop) included."""
    rows = _line_values(_by_trip(table(spark, sf, "lineitem"))).join(trips(spark, sf), "trip_id")
    stop_no = (F.col("r") * 5 + F.col("l_partkey") % 12) % 100
    arrival = F.col("day_epoch") + F.col("start_sec") + F.col("l_linenumber") * 150 + F.col("delay")
    known = F.col("l_tax") > 0
    return rows.select(
        (arrival - 60 * (F.col("l_suppkey") % 5) - 30).alias("feed_timestamp"),
        "trip_id", "route_id", "vehicle_id",
        F.concat(F.lit("S"), _t(stop_no)).alias("stop_id"),
        F.when(~F.col("day_unknown"), F.col("service_date")).alias("start_date"),
        F.col("l_linenumber").alias("stop_sequence"),
        F.col("delay").alias("arrival_delay_seconds"),
        F.when(known, F.col("delay") + F.col("q") % 30).alias("departure_delay_seconds"),
        arrival.alias("rt_arrival_time"),
        F.when(known, arrival + F.col("q")).alias("rt_departure_time"),
    )


def _by_trip(lines: DataFrame) -> DataFrame:
    """Lines under the id of their trip. They meet their trip by it, so that windows and groups along trips find a trip's rows in one place."""
    return lines.withColumn("trip_id", F.concat(F.lit("T"), _t(F.col("l_orderkey")))).drop("l_orderkey")


def trip_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One line per (trip, line number), the latest shipment, with its trip.

    A line number repeats a few times at most, so a window serves: it takes only the columns that are asked for, and its order is the join's.
    """
    lines = _by_trip(table(spark, sf, "lineitem")).repartition("trip_id")
    latest = Window.partitionBy("trip_id", "l_linenumber").orderBy(*[F.col(c).desc() for c in LINE_ORDER])
    return lines.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n").join(trips(spark, sf), "trip_id")


@kept
def stop_events(spark: SparkSession, sf: str) -> DataFrame:
    """Observed stop events: one row per trip and stop sequence."""
    rows = _line_values(trip_lines(spark, sf))
    stop_no = (F.col("r") * 5 + F.col("l_partkey") % 12) % 100
    q, delay = F.col("q"), F.col("delay")
    planned = F.col("day_epoch") + F.col("start_sec") + F.col("l_linenumber") * 150
    planned_dep = planned + (q % 4) * 10
    forecast = F.when(F.col("l_tax") > 0, delay + (F.col("l_suppkey") % 40).cast("int") - 20)
    return rows.select(
        "service_date", "trip_id", "route_id", "brigade",
        F.col("vehicle_id").alias("vehicle_number"), "vehicle_type",
        F.col("l_linenumber").alias("stop_sequence"),
        F.concat(F.lit("S"), _t(stop_no)).alias("stop_id"),
        F.concat(F.lit("Stop "), _t(stop_no)).alias("stop_name"),
        planned.alias("scheduled_arrival_utc"),
        planned_dep.alias("scheduled_departure_utc"),
        (planned + delay).alias("actual_arrival_utc"),
        (planned + delay + q).alias("actual_departure_utc"),
        delay.alias("arrival_delay_seconds"),
        (planned + delay + q - planned_dep).cast("int").alias("departure_delay_seconds"),
        q.alias("dwell_seconds"),
        forecast.alias("zbk_forecast_delay_s"),
        (delay - forecast).alias("forecast_error_s"),
        F.when((F.col("l_returnflag") == "A") & (q % 3 == 0), "PASSED").otherwise("STOPPED").alias("event_type"),
        F.when(q < 20, "HIGH").when(q < 35, "MEDIUM").otherwise("LOW").alias("confidence"),
    )


def events_k(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream with its JSON property ``k`` and epoch second."""
    k = F.get_json_object("props", "$.k").cast("int")
    second = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    return table(spark, sf, "events").withColumns({"k": k, "epoch": second})


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Station observations: one row per event, moved onto the service days."""
    k = F.col("k")
    moved = F.col("ts") + F.expr("interval 1008 days")
    mm = F.when(k % 3 == 0, 0.0).otherwise((k % 20) / F.lit(10.0))
    temp = F.col("value") - F.lit(5.0)
    return events_k(spark, sf).select(
        F.concat(F.lit("3522"), _t(F.col("user_id") % 4)).alias("station_id"),
        F.upper("event_type").alias("station_name"),
        moved.alias("timestamp"),
        temp.alias("temperature_c"),
        (F.lit(50) + k % 50).cast("double").alias("relative_humidity"),
        mm.alias("precipitation_mm"),
        ((k % 12) * F.lit(0.5)).alias("wind_speed_ms"),
        ((mm > 0) & (temp <= 0)).alias("freezing_rain_flag"),
    )


def road_links(spark: SparkSession, sf: str) -> DataFrame:
    """One candidate link per part; several parts may describe the same stop pair."""
    p = F.col("p_partkey")
    prev = p % 100
    cur = (prev + F.floor(p / F.lit(100)) % 23 + 89) % 100
    size = F.col("p_size")
    slug = p % 4 == 0
    length = F.round(F.col("p_retailprice") / F.lit(2.0), 1)
    return table(spark, sf, "part").select(
        F.concat(F.lit("E"), F.lpad(_t(p), 12, "0")).alias("edge_id"),
        F.when(size % 2 == 0, F.col("p_brand")).alias("corridor_name"),
        F.concat(F.lit("S"), _t(prev)).alias("stop_id_prev"),
        F.concat(F.lit("S"), _t(cur)).alias("stop_id_curr"),
        F.when(slug, F.concat(F.lit("S"), _t((prev + 1) % 100))).alias("slug_prev"),
        F.when(slug, F.concat(F.lit("S"), _t((cur + 2) % 100))).alias("slug_curr"),
        length.alias("segment_length_meters"),
        F.round(length * (F.lit(1.0) + (size % 10) / F.lit(20.0)), 1).alias("actual_path_length_meters"),
        (F.lit(1.0) + (size % 10) / F.lit(20.0)).alias("tortuosity_ratio"),
        (size % 6).cast("long").alias("signalized_intersection_count"),
        (size % 3 == 0).alias("is_dedicated_right_of_way"),
        (size % 3 + 1).cast("long").alias("lane_capacity"),
    )


def stop_hubs(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), _t(s % 100)).alias("stop_id"),
        F.when(s % 5 == 0, F.concat(F.lit("S"), _t((s + 7) % 100))).alias("zbk_slug"),
        s.alias("hub_no"),
        (F.col("s_nationkey") + 1).cast("long").alias("interchange_line_count"),
        F.when(F.col("s_nationkey") % 4 == 0, 1).otherwise(0).cast("long").alias("is_metro_proximity"),
    )


def network_links(spark: SparkSession, sf: str) -> DataFrame:
    """One link per stop pair, as in a link table of record."""
    return latest_per_key(road_links(spark, sf), ["stop_id_prev", "stop_id_curr"], [F.col("edge_id")])


def network_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return latest_per_key(stop_hubs(spark, sf), ["stop_id"], [F.col("hub_no")])


def service_days(spark: SparkSession, sf: str) -> DataFrame:
    return trips(spark, sf).select(F.to_date("service_date").alias("day")).distinct()


def dimensions(spark: SparkSession, sf: str) -> Dimensions:
    from fleetlens.functions.holidays import calendar_flags

    return Dimensions(
        weather=weather(spark, sf), links=road_links(spark, sf),
        calendar=calendar_flags(service_days(spark, sf)), hubs=stop_hubs(spark, sf),
    )


def schedule_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Timetable trips; the service id says which weekday pattern a trip belongs to."""
    pattern = F.when(F.dayofweek(F.to_date("service_date")).isin(1, 7), "WE").otherwise("WD")
    return trips(spark, sf).select("trip_id", "route_id", "brigade", pattern.alias("service_id"), "trip_no", "start_sec", "service_date")


def hhmmss(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / F.lit(3600)), F.floor(s / F.lit(60)) % 60, s % 60)


@kept
def stop_times(spark: SparkSession, sf: str) -> DataFrame:
    """Timetable stops of every trip, times as text."""
    rows = trip_lines(spark, sf)
    at = F.col("start_sec") + F.col("l_linenumber") * 150
    stop_no = (F.col("r") * 5 + F.col("l_partkey") % 12) % 100
    return rows.select(
        "trip_id", F.col("l_linenumber").alias("stop_sequence"), F.concat(F.lit("S"), _t(stop_no)).alias("stop_id"),
        hhmmss(at).alias("arrival_time"), hhmmss(at + (F.col("l_quantity").cast("int") % 4) * 10).alias("departure_time"))


def _stop_lat(stop_no: Column) -> Column:
    return F.lit(52.1) + stop_no * F.lit(0.002)


def _stop_lon(stop_no: Column) -> Column:
    return F.lit(20.9) + (stop_no % 10) * F.lit(0.003)


def stops(spark: SparkSession, sf: str) -> DataFrame:
    """Stops named by the timetable."""
    no = F.substring("stop_id", 2, 10).cast("int")
    return stop_times(spark, sf).select("stop_id").distinct().select(
        "stop_id", F.concat(F.lit("Stop "), _t(no)).alias("stop_name"),
        _stop_lat(no).alias("stop_lat"), _stop_lon(no).alias("stop_lon"))


@kept
def vehicle_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """Seven fixes around every timetable stop: a vehicle that approaches, passes and leaves.

    What the seven share is made before them, once; filters on their times then repeat a short sum only.
    """
    rows = _line_values(trip_lines(spark, sf))
    stop_no = (F.col("r") * 5 + F.col("l_partkey") % 12) % 100
    side = F.when(F.col("l_suppkey") % 13 == 0, 70).otherwise((F.col("l_partkey") % 5) * 8)
    at = F.col("day_epoch") + F.col("start_sec") + F.col("l_linenumber") * 150 + F.col("delay")
    age = F.when(F.col("l_partkey") % 50 == 0, 400).when(F.col("l_partkey") % 50 == 1, 3600).otherwise(F.col("q") % 5)
    shared = rows.select(
        "service_date", "vehicle_type",
        F.when(F.col("l_suppkey") % 11 == 0, "X1").otherwise(F.col("vehicle_id")).alias("vehicle_number"),
        "route_id", "brigade", (_stop_lat(stop_no) + side / F.lit(111271.72)).alias("lat"), _stop_lon(stop_no).alias("stop_lon"),
        at.alias("at"), age.alias("age"), "trip_id")
    wide = shared.withColumn("j", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    gps = F.col("at") + F.col("j") * 12
    base = wide.select(
        "service_date", "vehicle_type", "vehicle_number", "route_id", "brigade", "lat",
        (F.col("stop_lon") + F.col("j") * 11 / F.lit(68325.49)).alias("lon"),
        gps.alias("gps_timestamp_utc"), (gps + F.col("age")).alias("tick_ts"), "trip_id")
    from fleetlens.functions import clock

    text = F.substring(clock.epoch_to_local("gps_timestamp_utc").cast("string"), 1, 19)
    return base.withColumn("gps_time_str", text)


def raw_pings(spark: SparkSession, sf: str) -> DataFrame:
    """Event pings with a coarse onboard clock, so that repeats occur."""
    k = F.col("k")
    e = events_k(spark, sf)
    day = F.floor(F.col("epoch") / F.lit(86400)) * 86400
    return e.select(
        F.lit("all").alias("service_date"),
        F.when(F.col("user_id") % 3 == 0, "tram").otherwise("bus").alias("vehicle_type"),
        _t(F.col("user_id") % 40).alias("vehicle_number"),
        F.lit("190").alias("route_id"), F.lit("1").alias("brigade"),
        (F.lit(52.2) + (k % 2) * F.lit(0.001)).alias("lat"), (F.lit(21.0) + (k % 3) * F.lit(0.0001)).alias("lon"),
        (day + F.floor(F.col("epoch") % 86400 / F.lit(43200)) * 43200).alias("gps_timestamp_utc"),
        _t(day + F.floor(F.col("epoch") % 86400 / F.lit(43200)) * 43200).alias("gps_time_str"),
        F.col("epoch").alias("tick_ts"))


def legacy_dimensions(spark: SparkSession, sf: str) -> Dimensions:
    """Dimensions of the legacy mart: its either-key joins expect one row per link and per stop."""
    d = dimensions(spark, sf)
    return Dimensions(d.weather, network_links(spark, sf), d.calendar, network_hubs(spark, sf))
