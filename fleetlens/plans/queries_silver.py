"""Registered queries: trajectories, timetable and trip match."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import kinematics, schedule
from fleetlens.plans import domain, silver
from fleetlens.plans.registry import comparable, comparable_sql, query
from fleetlens.plans.views_sql import with_views


def movement_steps(source: str) -> list[tuple[str, str]]:
    """Repeat collapse and movement as SQL over a table of fixes."""
    order = "gps_timestamp_utc, tick_ts, gps_time_str, lat, lon"
    veh = "PARTITION BY service_date, vehicle_type, vehicle_number"
    return [
        ("flagged", f"""SELECT *, CASE WHEN lag(gps_time_str) OVER w = gps_time_str AND lag(lat) OVER w = lat AND lag(lon) OVER w = lon
           THEN 0 ELSE 1 END AS fresh FROM {source} WINDOW w AS ({veh} ORDER BY {order})"""),
        ("runs", f"SELECT *, sum(fresh) OVER ({veh} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM flagged"),
        ("collapsed", f"""SELECT *, count(*) OVER ({veh}, run)::INTEGER AS n_ticks_seen FROM runs QUALIFY fresh = 1"""),
        ("stepped", f"""SELECT *, COALESCE(CASE WHEN gps_timestamp_utc > lag(gps_timestamp_utc) OVER w THEN gps_timestamp_utc - lag(gps_timestamp_utc) OVER w END, 0)::DOUBLE AS dt,
           COALESCE(CASE WHEN gps_timestamp_utc > lag(gps_timestamp_utc) OVER w THEN sqrt(pow((lon - lag(lon) OVER w)*68325.49::DOUBLE, 2) + pow((lat - lag(lat) OVER w)*111271.72::DOUBLE, 2)) END, 0)::DOUBLE AS dd
           FROM collapsed WINDOW w AS ({veh} ORDER BY {order})"""),
        ("moved", """SELECT *, dt AS delta_t_s, round_even(dd, 2) AS delta_d_m, round_even(v, 2) AS speed_mps, v < 0.5 AND dd < 5.0 AS is_static
           FROM (SELECT *, CASE WHEN dt > 0 THEN dd/dt ELSE 0.0 END AS v FROM stepped)"""),
    ]


MOVED = dict(service_date="s", vehicle_type="s", vehicle_number="s", gps_timestamp_utc="i", tick_ts="i", lat="d", lon="d",
             n_ticks_seen="i", delta_t_s="d", delta_d_m="d", speed_mps="d", is_static="b")


@query("w13_collapse_repeats", with_views(["raw_pings"], comparable_sql(
    {k: v for k, v in MOVED.items() if k in ("service_date", "vehicle_type", "vehicle_number", "gps_timestamp_utc", "tick_ts", "lat", "lon", "n_ticks_seen")},
    "collapsed"), movement_steps("raw_pings")[:3]))
def collapse(spark, sf):
    c = kinematics.collapse_repeats(domain.raw_pings(spark, sf))
    return comparable(c.select("service_date", "vehicle_type", "vehicle_number", "gps_timestamp_utc", "tick_ts", "lat", "lon", "n_ticks_seen"))


@query("w12_movement", with_views(["raw_pings"], comparable_sql(MOVED, "moved"), movement_steps("raw_pings")))
def movement(spark, sf):
    return comparable(kinematics.with_movement(kinematics.clean_fixes(domain.raw_pings(spark, sf))).select(*MOVED))


CALENDAR = ("weekly", """SELECT 'WD' AS service_id, 1 AS monday, 1 AS tuesday, 1 AS wednesday, 1 AS thursday, 1 AS friday, 0 AS saturday, 0 AS sunday,
  strftime(min(service_date::DATE), '%Y%m%d') AS start_date, strftime(max(service_date::DATE), '%Y%m%d') AS end_date FROM trips
 UNION ALL SELECT 'WE', 0, 0, 0, 0, 0, 1, 1, strftime(min(service_date::DATE), '%Y%m%d'), strftime(max(service_date::DATE) - 1, '%Y%m%d') FROM trips""")
EXCEPTIONS = ("exceptions", """SELECT DISTINCT CASE WHEN day(service_date::DATE) % 2 = 0 THEN 'WD' ELSE 'WE' END AS service_id, strftime(service_date::DATE, '%Y%m%d') AS date,
  CASE WHEN day(service_date::DATE) % 2 = 0 THEN 2 ELSE 1 END AS exception_type FROM trips WHERE day(service_date::DATE) % 9 IN (0, 4)""")
ACTIVE = ("active", """SELECT service_date, service_id FROM (SELECT DISTINCT service_date, strftime(service_date::DATE, '%Y%m%d') AS d, lower(dayname(service_date::DATE)) AS wd FROM trips) days
  JOIN weekly ON start_date <= d AND end_date >= d AND CASE wd WHEN 'monday' THEN monday WHEN 'tuesday' THEN tuesday WHEN 'wednesday' THEN wednesday WHEN 'thursday' THEN thursday
   WHEN 'friday' THEN friday WHEN 'saturday' THEN saturday ELSE sunday END = 1
   AND service_id NOT IN (SELECT service_id FROM exceptions e WHERE e.date = d AND exception_type = 2)
  UNION SELECT service_date, service_id FROM (SELECT DISTINCT service_date, strftime(service_date::DATE, '%Y%m%d') AS d FROM trips) days JOIN exceptions ON date = d AND exception_type = 1""")


def calendars(spark, sf):
    """Weekly services and exceptions derived from the trip days."""
    t = domain.trips(spark, sf)
    day = F.to_date("service_date")
    bounds = t.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    weekdays = ["monday", "tuesday", "wednesday", "thursday", "friday"]
    rows = [F.struct(F.lit("WD").alias("service_id"), *[F.lit(1).alias(n) for n in weekdays], F.lit(0).alias("saturday"), F.lit(0).alias("sunday"), F.col("b").alias("last")),
            F.struct(F.lit("WE").alias("service_id"), *[F.lit(0).alias(n) for n in weekdays], F.lit(1).alias("saturday"), F.lit(1).alias("sunday"), F.date_sub("b", 1).alias("last"))]
    weekly = bounds.select("a", F.explode(F.array(*rows)).alias("r")).select(
        "r.*", F.date_format("a", "yyyyMMdd").alias("start_date"), F.date_format("r.last", "yyyyMMdd").alias("end_date")).drop("last")
    even = F.dayofmonth(day) % 2 == 0
    exceptions = t.filter((F.dayofmonth(day) % 9).isin(0, 4)).select(
        F.when(even, "WD").otherwise("WE").alias("service_id"), F.date_format(day, "yyyyMMdd").alias("date"),
        F.when(even, 2).otherwise(1).alias("exception_type")).distinct()
    return weekly, exceptions


def active(spark, sf):
    weekly, exceptions = calendars(spark, sf)
    return schedule.active_services(domain.trips(spark, sf).select("service_date"), weekly, exceptions)


@query("j7_active_services", with_views(["trips"], "SELECT service_date, service_id FROM active", [CALENDAR, EXCEPTIONS, ACTIVE]))
def active_services(spark, sf):
    return active(spark, sf)


SPANS = ("spans", f"""SELECT t.trip_id, t.route_id, t.brigade, t.service_id, min(departure_time) AS trip_start, max(arrival_time) AS trip_end
  FROM schedule_trips t JOIN stop_times st ON t.trip_id = st.trip_id WHERE t.brigade IS NOT NULL GROUP BY ALL""")
DAILY = ("daily", "SELECT * FROM spans JOIN active USING (service_id)")
_SEC = "(split_part({0},':',1)::INTEGER*3600 + split_part({0},':',2)::INTEGER*60 + split_part({0},':',3)::INTEGER)"


def spans(spark, sf):
    return schedule.trip_spans(domain.schedule_trips(spark, sf), domain.stop_times.view(spark, sf))


@query("j8_trip_spans", with_views(["schedule_trips", "stop_times"], f"""SELECT service_date, trip_id, route_id, brigade, trip_start, trip_end, {_SEC.format('trip_start')}::BIGINT AS start_sec FROM daily""",
                                   [CALENDAR, EXCEPTIONS, ACTIVE, SPANS, DAILY]))
def day_spans(spark, sf):
    return comparable(schedule.spans_by_day(spans(spark, sf), active(spark, sf)).select(
        "service_date", "trip_id", "route_id", "brigade", "trip_start", "trip_end", "start_sec"))


MATCH = [CALENDAR, EXCEPTIONS, ACTIVE, SPANS, DAILY,
    ("fresh", "SELECT * FROM vehicle_fixes WHERE tick_ts - gps_timestamp_utc <= 300 AND gps_timestamp_utc - tick_ts <= 120"),
    *movement_steps("fresh"),
    ("usable", f"""SELECT service_date, route_id, brigade, trip_id AS tid, trip_start, {_SEC.format('trip_start')} AS st, {_SEC.format('trip_end')} AS en FROM daily
      UNION ALL SELECT d.service_date, s.route_id, s.brigade, s.trip_id, s.trip_start, {_SEC.format('trip_start')}, {_SEC.format('trip_end')}
      FROM spans s JOIN (SELECT DISTINCT service_date FROM trips WHERE service_date NOT IN (SELECT service_date FROM daily)) d ON true"""),
    ("timed", f"SELECT *, {_SEC.format('''right(gps_time_str, 8)''')} AS s, row_number() OVER () AS fix_no FROM moved"),
    ("costed", """SELECT fix_no, tid, trip_start, least(CASE WHEN s BETWEEN st - 900 AND en + 2700 THEN CASE WHEN s < st THEN st - s + 900 WHEN s <= en THEN 0 ELSE s - en END ELSE 1000000000 END,
       CASE WHEN s < 18000 AND s + 86400 BETWEEN st - 900 AND en + 2700 THEN CASE WHEN s + 86400 < st THEN st - s - 86400 + 900 WHEN s + 86400 <= en THEN 0 ELSE s + 86400 - en END ELSE 1000000000 END) AS cost
      FROM timed JOIN usable USING (service_date, route_id, brigade)"""),
    ("best", "SELECT fix_no, tid FROM costed WHERE cost < 1000000000 QUALIFY row_number() OVER (PARTITION BY fix_no ORDER BY cost, trip_start, tid) = 1"),
    ("silver", """SELECT timed.* REPLACE (delta_t_s::FLOAT AS delta_t_s, delta_d_m::FLOAT AS delta_d_m, speed_mps::FLOAT AS speed_mps),
       tid AS matched_trip_id FROM timed LEFT JOIN best USING (fix_no)""")]
SILVER_KINDS = {**MOVED, "route_id": "s", "brigade": "s", "gps_time_str": "s", "matched_trip_id": "s"}
FIX_COLUMNS = ["service_date", "vehicle_type", "vehicle_number", "route_id", "brigade", "lat", "lon", "gps_timestamp_utc", "gps_time_str", "tick_ts"]


def trajectories(spark, sf):
    return silver.trajectories(domain.vehicle_fixes.view(spark, sf).select(*FIX_COLUMNS), spans(spark, sf), active(spark, sf))


@query("c1_silver_trajectories", with_views(["vehicle_fixes", "schedule_trips", "stop_times"], comparable_sql(SILVER_KINDS, "silver", 2), MATCH))
def silver_trajectories(spark, sf):
    return comparable(trajectories(spark, sf).select(*SILVER_KINDS), 2)


@query("j9_interval_nearest_trip", with_views(["vehicle_fixes", "schedule_trips", "stop_times"], """SELECT service_date, vehicle_number, gps_timestamp_utc, tick_ts, route_id, brigade, matched_trip_id FROM silver""", MATCH))
def interval_match(spark, sf):
    moved = kinematics.collapse_repeats(silver.fresh_fixes(domain.vehicle_fixes.view(spark, sf).select(*FIX_COLUMNS)))
    return schedule.match_trips(moved, spans(spark, sf), active(spark, sf)).select(
        "service_date", "vehicle_number", "gps_timestamp_utc", "tick_ts", "route_id", "brigade", "matched_trip_id")
