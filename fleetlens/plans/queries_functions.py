"""Registered queries: scalar functions and row predicates over the source tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import clock, geo, transit
from fleetlens.functions.holidays import calendar_flags
from fleetlens.functions.rounding import round_half_even, round_half_up
from fleetlens.operators import dimensions as dim
from fleetlens.plans import domain
from fleetlens.plans.queries_mart import HUB_STEPS, LINK_STEPS
from fleetlens.plans.registry import comparable, query
from fleetlens.plans.views_sql import calendar_sql, with_views

ORDER_DAYS = "SELECT DISTINCT o_orderdate::DATE + 10592 AS day FROM orders"


@query("s12_calendar_dimension", f"WITH days AS ({ORDER_DAYS}) {calendar_sql('days')}")
def calendar_dimension(spark, sf):
    days = domain.table(spark, sf, "orders").select(F.date_add(F.to_date("o_orderdate"), 10592).alias("day")).distinct()
    return comparable(calendar_flags(days))


@query("f1_local_time", with_views(["stop_updates"], """SELECT trip_id, feed_timestamp, strftime(t, '%Y-%m-%d %H:%M:%S') AS local_time,
 strftime(date_trunc('hour', t), '%Y-%m-%d %H:%M:%S') AS local_hour, hour(t) AS hour_of_day, dayofweek(t) AS day_of_week,
 CASE WHEN dayofweek(t) IN (0,6) THEN 1 ELSE 0 END AS is_weekend, CASE WHEN hour(t) IN (7,8,9,16,17,18) THEN 1 ELSE 0 END AS is_peak_hour
 FROM (SELECT *, timezone('Europe/Warsaw', to_timestamp(feed_timestamp)) AS t FROM stop_updates)"""))
def local_time(spark, sf):
    cal = transit.calendar_columns(clock.epoch_to_local("feed_timestamp"))
    return comparable(domain.stop_updates(spark, sf).select(
        "trip_id", "feed_timestamp", cal["arrival_ts"].alias("local_time"), cal["timestamp_bucket"].alias("local_hour"),
        *[cal[c].alias(c) for c in ("hour_of_day", "day_of_week", "is_weekend", "is_peak_hour")]))


_WALL = "strftime(TIMESTAMP '2026-10-25 00:00:00' + to_seconds((epoch*37) % 14400), '%Y-%m-%d %H:%M:%S')"
_TICK = "1792879200 + (epoch*53) % 18000"


@query("f2_local_text_to_epoch", with_views(["events_k"], """SELECT event_id, text, tick, CASE WHEN event_id % 11 = 0 THEN tick
  WHEN early != late AND abs(late - tick) < abs(early - tick) THEN late ELSE early END AS gps FROM (
 SELECT *, CASE WHEN wall < TIMESTAMP '2026-10-25 03:00:00' THEN epoch(wall)::BIGINT - 7200 ELSE epoch(wall)::BIGINT - 3600 END AS early,
  CASE WHEN wall < TIMESTAMP '2026-10-25 02:00:00' THEN epoch(wall)::BIGINT - 7200 ELSE epoch(wall)::BIGINT - 3600 END AS late
 FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'not a time' ELSE w END AS text, """ + _TICK + """ AS tick, w::TIMESTAMP AS wall
  FROM (SELECT *, """ + _WALL + """ AS w FROM events_k)))"""))
def local_text(spark, sf):
    rows = domain.events_k(spark, sf)
    wall = F.timestamp_add("SECOND", (F.col("epoch") * 37) % 14400, F.expr("timestamp_ntz'2026-10-25 00:00:00'")).cast("string")
    text = F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(wall)
    tick = F.lit(1792879200) + (F.col("epoch") * 53) % 18000
    parsed = rows.select("event_id", text.alias("text"), tick.alias("tick"))
    return comparable(parsed.withColumn("gps", clock.parse_local_text("text", "tick")))


_HHMMSS = "lpad((s//3600)::VARCHAR, 2, '0')||':'||lpad(((s//60) % 60)::VARCHAR, 2, '0')||':'||lpad((s % 60)::VARCHAR, 2, '0')"


def hhmmss(seconds):
    return F.concat_ws(":", *[F.lpad(F.floor(x).cast("string"), 2, "0") for x in
                              (seconds / 3600, (seconds / 60) % 60, seconds % 60)])


@query("f3_timetable_epoch", with_views(["trips"], f"""SELECT trip_id, service_date, text, s AS seconds,
 (epoch(timezone('Europe/Warsaw', wall)))::BIGINT AS at_epoch FROM (
 SELECT *, service_date::TIMESTAMP + to_days((s // 86400)::INTEGER) + to_seconds(s % 86400) AS wall FROM (
 SELECT *, {_HHMMSS} AS text FROM (SELECT trip_id, service_date, start_sec + trip_no % 60 AS s FROM trips)))"""))
def timetable(spark, sf):
    rows = domain.trips(spark, sf).select("trip_id", "service_date", hhmmss(F.col("start_sec") + F.col("trip_no") % 60).alias("text"))
    return comparable(rows.select("*", clock.timetable_seconds("text").alias("seconds"),
                                  clock.timetable_epoch("service_date", "text").alias("at_epoch")))


@query("f5_f6_projection_and_distance", with_views(["events_k"], """SELECT event_id, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y,
 round(x/68325.49 + 21.01, 6) AS back_lon, round(y/111271.72 + 52.23, 6) AS back_lat, round(sqrt(x*x + y*y),6) AS planar_m,
 round(2*6371000.0*atan2(sqrt(a), sqrt(1-a)),4) AS great_circle_m FROM (SELECT *,
  pow(sin(radians(lat-52.23::DOUBLE)/2),2) + cos(radians(52.23::DOUBLE))*cos(radians(lat))*pow(sin(radians(lon-21.01::DOUBLE)/2),2) AS a FROM (
 SELECT event_id, lat, lon, (lon-21.01::DOUBLE)*68325.49::DOUBLE AS x, (lat-52.23::DOUBLE)*111271.72::DOUBLE AS y
 FROM (SELECT event_id, 52.1::DOUBLE + k*0.003::DOUBLE AS lat, 20.9::DOUBLE + (user_id % 70)*0.004::DOUBLE AS lon FROM events_k)))"""))
def projection(spark, sf):
    p = domain.events_k(spark, sf).select("event_id", (F.lit(52.1) + F.col("k") * F.lit(0.003)).alias("lat"),
                                          (F.lit(20.9) + (F.col("user_id") % 70) * F.lit(0.004)).alias("lon"))
    x, y, lat, lon = geo.planar_x(F.col("lon")), geo.planar_y(F.col("lat")), F.lit(geo.LAT_0), F.lit(geo.LON_0)
    return comparable(p.select(
        "event_id", x.alias("x"), y.alias("y"), geo.planar_lon(x).alias("back_lon"), geo.planar_lat(y).alias("back_lat"),
        geo.planar_distance(lat, lon, F.col("lat"), F.col("lon")).alias("planar_m"),
        round_half_up(geo.great_circle(lat, lon, F.col("lat"), F.col("lon")), 4).alias("great_circle_m")))


@query("f7_crossing_time", """SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(d_out-d_in) < 0.0001 THEN t_out
 ELSE t_out + greatest(0.0, least(1.0, (d_out-25.0)/nullif(d_out-d_in,0)))*(t_in-t_out) END, 6) + 0.0 AS crossed FROM (
 SELECT l_orderkey, l_linenumber, l_linenumber*100.0::DOUBLE AS t_out, l_linenumber*100.0::DOUBLE + 10 AS t_in,
  l_quantity + l_partkey % 20 AS d_out, (l_suppkey % 50)::DOUBLE AS d_in FROM lineitem)""")
def crossing(spark, sf):
    r = domain.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") * F.lit(100.0)).alias("t"),
        (F.col("l_quantity") + F.col("l_partkey") % 20).alias("d_out"), (F.col("l_suppkey") % 50).cast("double").alias("d_in"))
    return comparable(r.select("l_orderkey", "l_linenumber",
                               geo.crossing_time(F.col("t"), F.col("d_out"), F.col("t") + 10, F.col("d_in")).alias("crossed")))


@query("f8_normalized_names", """SELECT doc_id, regexp_replace(translate(lower(text), 'ąćęłńóśźż', 'acelnoszz'), '[^a-z0-9]', '', 'g') AS n_name FROM documents""")
def normalized(spark, sf):
    return domain.table(spark, sf, "documents").select("doc_id", transit.normalize_name(F.col("text")).alias("n_name"))


@query("f12_safe_casts", """SELECT c_custkey, TRY_CAST(c_name AS INTEGER)::BIGINT AS not_a_number, upper(c_mktsegment) LIKE 'A%' AS starts_a,
 lpad(right(c_name, 2), 3, '0') AS tail, COALESCE(NULLIF(c_nationkey, 0), -1)::BIGINT AS nation, greatest(c_acctbal, 0.0) AS credit,
 ceil(c_acctbal)::BIGINT AS up, format('{:04d}', c_nationkey) AS code FROM customer""")
def safe_casts(spark, sf):
    c = domain.table(spark, sf, "customer")
    return comparable(c.select(
        "c_custkey", F.col("c_name").try_cast("int").alias("not_a_number"), F.upper("c_mktsegment").like("A%").alias("starts_a"),
        F.lpad(F.substring("c_name", -2, 2), 3, "0").alias("tail"),
        F.coalesce(F.nullif(F.col("c_nationkey"), F.lit(0)), F.lit(-1)).alias("nation"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("credit"), F.ceil("c_acctbal").alias("up"),
        F.format_string("%04d", "c_nationkey").alias("code")))


@query("f13_f14_hash_order_and_digest", """SELECT conv_id, turn, md5(role||'_42') AS order_key, sha256(text) AS payload_sha256 FROM conversations""")
def digests(spark, sf):
    c = domain.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", transit.seeded_order(F.col("role"), 42).alias("order_key"), F.sha2("text", 256).alias("payload_sha256"))


@query("f15_next_grid_tick", with_views(["events_k"], "SELECT event_id, (epoch // 10 + 1)*10 AS tick10, (epoch // 30 + 1)*30 AS tick30 FROM events_k"))
def grid(spark, sf):
    e = domain.events_k(spark, sf)
    return e.select("event_id", clock.next_grid_tick("epoch", 10).alias("tick10"), clock.next_grid_tick("epoch", 30).alias("tick30"))


@query("f16_two_roundings", """SELECT p_partkey, round(p_size/8.0::DOUBLE, 2) AS half_up, round_even(p_size/8.0::DOUBLE, 2) AS half_even FROM part""")
def roundings(spark, sf):
    x = F.col("p_size") / F.lit(8.0)
    return domain.table(spark, sf, "part").select("p_partkey", round_half_up(x, 2).alias("half_up"), round_half_even(x, 2).alias("half_even"))


@query("p1_p2_event_filters", with_views(["stop_events"], """SELECT trip_id, stop_sequence, event_type, arrival_delay_seconds FROM stop_events
 WHERE event_type IN ('STOPPED','PASSED') AND actual_arrival_utc IS NOT NULL AND abs(arrival_delay_seconds) <= 7200"""))
def event_filters(spark, sf):
    e = domain.stop_events(spark, sf)
    kept = e.filter(F.col("event_type").isin("STOPPED", "PASSED") & F.col("actual_arrival_utc").isNotNull()
                    & (F.abs("arrival_delay_seconds") <= 7200))
    return kept.select("trip_id", "stop_sequence", "event_type", "arrival_delay_seconds")


@query("p3_local_range", with_views(["stop_updates"], """SELECT trip_id, stop_sequence, feed_timestamp FROM (
 SELECT *, timezone('Europe/Warsaw', to_timestamp(feed_timestamp)) AS t FROM stop_updates)
 WHERE t::DATE >= DATE '2026-10-12' AND t <= TIMESTAMP '2026-10-25 02:30:00'"""))
def local_range(spark, sf):
    u = domain.stop_updates(spark, sf)
    return u.filter(transit.local_range(F.col("feed_timestamp"), "2026-10-12", " 2026-10-25 02:30:00 ")).select("trip_id", "stop_sequence", "feed_timestamp")


@query("p4_rain_bins", with_views(["weather"], """SELECT station_id, precipitation_mm, CASE WHEN precipitation_mm > 0 THEN 1 ELSE 0 END AS is_raining,
 CASE WHEN precipitation_mm = 0 THEN 0 WHEN precipitation_mm <= 0.5 THEN 1 WHEN precipitation_mm <= 1.5 THEN 2 ELSE 3 END AS rain_intensity_category FROM weather"""))
def rain_bins(spark, sf):
    mm = F.col("precipitation_mm")
    return domain.weather(spark, sf).select("station_id", mm, transit.flag(mm > 0).alias("is_raining"),
                                            transit.rain_category(mm).alias("rain_intensity_category"))


@query("p5_p6_clock_repair", with_views(["events_k"], """SELECT event_id, tick, g AS gps FROM (SELECT event_id, tick,
  CASE WHEN tick - gps BETWEEN 3400 AND 3800 THEN gps + 3600 ELSE gps END AS g
  FROM (SELECT event_id, epoch AS tick, epoch - (CASE WHEN k % 10 = 0 THEN 3600 ELSE 0 END) - (user_id*7 % 600 - 150) AS gps FROM events_k))
 WHERE tick - g <= 300 AND g - tick <= 120"""))
def clock_repair(spark, sf):
    e = domain.events_k(spark, sf)
    shift = F.when(F.col("k") % 10 == 0, 3600).otherwise(0)
    raw = e.select("event_id", F.col("epoch").alias("tick"), (F.col("epoch") - shift - (F.col("user_id") * 7 % 600 - 150)).alias("raw"))
    fixed = raw.withColumn("gps", clock.repair_clock_fold("raw", "tick")).drop("raw")
    return fixed.filter(clock.clock_is_fresh("gps", "tick"))


# Route number bands and route letters of the cohorts.
COHORT_STEPS = [("bands", "SELECT * FROM (VALUES (1, 79, 'urban_tram'), (100, 599, 'urban_bus'), (700, 899, 'suburban_bus')) AS v(low, high, cohort)"),
    ("letters", "SELECT * FROM (VALUES ('L', 'suburban_bus'), ('N', 'night_bus')) AS v(letter, cohort)"),
    ("numbered", "SELECT *, TRY_CAST(route_id AS INTEGER) AS route_no, upper(left(route_id, 1)) AS letter FROM trips")]


@query("p14_cohorts", with_views(["trips"], """SELECT trip_id, route_id, (vehicle_type = 'tram' OR ifnull(route_no < 100, false))::INTEGER AS is_tram,
 if(vehicle_type = 'tram', 'urban_tram', COALESCE(bands.cohort, letters.cohort, 'other')) AS transit_cohort
 FROM numbered LEFT JOIN bands ON route_no BETWEEN low AND high LEFT JOIN letters USING (letter)""", COHORT_STEPS))
def cohorts(spark, sf):
    t = domain.trips(spark, sf)
    r, v = F.col("route_id"), F.col("vehicle_type")
    return t.select("trip_id", "route_id", transit.is_tram(r, v).alias("is_tram"), transit.cohort(r, v).alias("transit_cohort"))


@query("p18_downcast", """SELECT l_orderkey, l_linenumber, round(l_extendedprice::FLOAT::DOUBLE, 6) AS price32, l_quantity::INTEGER::BIGINT AS qty32 FROM lineitem""")
def downcast(spark, sf):
    from fleetlens.operators.sampling import downcast as narrow

    li = domain.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price32"),
                                                   F.col("l_quantity").cast("long").alias("qty32"))
    return comparable(narrow(li, ["qty32"]))


@query("a1_hourly_weather", with_views(["weather"], """SELECT strftime(date_trunc('hour', "timestamp"), '%Y-%m-%d %H:%M:%S') AS "timestamp", round(avg(temperature_c),6)+0.0 AS temperature_c,
 max(precipitation_mm) AS precipitation_mm, round(avg(wind_speed_ms),6) AS wind_speed_ms, round(avg(relative_humidity),6) AS relative_humidity,
 bool_or(freezing_rain_flag) AS freezing_rain_flag FROM weather GROUP BY 1"""))
def hourly_weather(spark, sf):
    return comparable(dim.hourly_rollup(domain.weather(spark, sf)))


@query("w9_rain_lags", with_views(["weather"], """SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS "timestamp", mm AS precipitation_mm, COALESCE(lag(mm) OVER (ORDER BY h), 0.0) AS precip_lag_1h,
 round(sum(mm) OVER (ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),6) AS precip_3h_cumulative
 FROM (SELECT date_trunc('hour', "timestamp") AS h, max(precipitation_mm) AS mm FROM weather GROUP BY 1)"""))
def rain_lags(spark, sf):
    return comparable(dim.weather_by_hour(domain.weather(spark, sf)).select("timestamp", "precipitation_mm", "precip_lag_1h", "precip_3h_cumulative"))


@query("j3_links_by_either_key", with_views(["road_links"], "SELECT jp AS join_prev, jc AS join_curr, edge_id, corridor_name, segment_length_meters FROM osm", LINK_STEPS))
def links_either(spark, sf):
    return dim.links_by_either_key(domain.road_links(spark, sf)).select("join_prev", "join_curr", "edge_id", "corridor_name", "segment_length_meters")


@query("j4_hubs_by_either_key", with_views(["stop_hubs"], "SELECT js AS join_stop_id, hub_no, interchange_line_count, is_metro_proximity FROM hub", HUB_STEPS))
def hubs_either(spark, sf):
    return dim.hubs_by_either_key(domain.stop_hubs(spark, sf), "hub_no").select("join_stop_id", "hub_no", "interchange_line_count", "is_metro_proximity")
