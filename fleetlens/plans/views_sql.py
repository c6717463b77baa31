"""The transit views of ``domain`` as DuckDB SQL, used only by the correctness oracle."""

from __future__ import annotations

_ROUTE = """CASE WHEN r < 6 THEN (r+1)::VARCHAR WHEN r < 18 THEN (100+r*7)::VARCHAR
 WHEN r < 22 THEN (700+r)::VARCHAR WHEN r < 25 THEN 'L'||r::VARCHAR WHEN r < 28 THEN 'N'||r::VARCHAR
 ELSE (900+r)::VARCHAR END"""

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = (needs, sql)


_view("trips", [], f"""
SELECT o_orderkey AS trip_no, 'T'||o_orderkey::VARCHAR AS trip_id, r, {_ROUTE} AS route_id,
 (DATE '2026-10-05' + d::INTEGER)::VARCHAR AS service_date, (o_orderkey % 3 + 1)::VARCHAR AS brigade,
 'V'||(o_orderkey % 250)::VARCHAR AS vehicle_id, CASE WHEN r < 6 THEN 'tram' ELSE 'bus' END AS vehicle_type,
 18000 + (o_orderkey*7) % 80 * 900 AS start_sec, 1791158400 + d*86400 - 7200 AS day_epoch,
 o_orderstatus = 'P' AS day_unknown
FROM (SELECT *, o_custkey % 30 AS r,
  ((date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 28) + 28) % 28 AS d FROM orders)""")

_LINE = """SELECT *, l_quantity::INTEGER AS q,
 ((l_partkey*7 + l_suppkey*13 + l_quantity::INTEGER*11) % 420 - 90
  + CASE WHEN l_partkey % 89 = 0 THEN 8000 WHEN l_suppkey % 17 = 0 THEN 700 ELSE 0 END)::INTEGER AS delay"""

_view("stop_updates", ["trips"], f"""
SELECT arr - 60*(l_suppkey % 5) - 30 AS feed_timestamp, trip_id, route_id, vehicle_id,
 'S'||((r*5 + l_partkey % 12) % 100)::VARCHAR AS stop_id,
 CASE WHEN NOT day_unknown THEN service_date END AS start_date, l_linenumber AS stop_sequence,
 delay AS arrival_delay_seconds, CASE WHEN l_tax > 0 THEN delay + q % 30 END AS departure_delay_seconds,
 arr AS rt_arrival_time, CASE WHEN l_tax > 0 THEN arr + q END AS rt_departure_time
FROM (SELECT *, day_epoch + start_sec + l_linenumber*150 + delay AS arr
 FROM ({_LINE} FROM lineitem) JOIN trips ON l_orderkey = trip_no)""")

_view("latest_lines", [], """
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
 l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1""")

_view("stop_events", ["trips", "latest_lines"], f"""
SELECT service_date, trip_id, route_id, brigade, vehicle_id AS vehicle_number, vehicle_type,
 l_linenumber AS stop_sequence, 'S'||stop_no::VARCHAR AS stop_id, 'Stop '||stop_no::VARCHAR AS stop_name,
 planned AS scheduled_arrival_utc, planned + (q % 4)*10 AS scheduled_departure_utc,
 planned + delay AS actual_arrival_utc, planned + delay + q AS actual_departure_utc,
 delay AS arrival_delay_seconds, (delay + q - (q % 4)*10)::INTEGER AS departure_delay_seconds, q AS dwell_seconds,
 CASE WHEN l_tax > 0 THEN (delay + l_suppkey % 40 - 20)::INTEGER END AS zbk_forecast_delay_s,
 CASE WHEN l_tax > 0 THEN (20 - l_suppkey % 40)::INTEGER END AS forecast_error_s,
 CASE WHEN l_returnflag = 'A' AND q % 3 = 0 THEN 'PASSED' ELSE 'STOPPED' END AS event_type,
 CASE WHEN q < 20 THEN 'HIGH' WHEN q < 35 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM (SELECT *, (r*5 + l_partkey % 12) % 100 AS stop_no, day_epoch + start_sec + l_linenumber*150 AS planned
 FROM ({_LINE} FROM latest_lines) JOIN trips ON l_orderkey = trip_no)""")

_view("events_k", [], """
SELECT *, json_extract_string(props, '$.k')::INTEGER AS k, floor(epoch(ts))::BIGINT AS epoch FROM events""")

_view("weather", ["events_k"], """
SELECT '3522'||(user_id % 4)::VARCHAR AS station_id, upper(event_type) AS station_name,
 ts + INTERVAL 1008 DAY AS "timestamp", value - 5.0::DOUBLE AS temperature_c,
 (50 + k % 50)::DOUBLE AS relative_humidity, mm AS precipitation_mm, (k % 12)*0.5::DOUBLE AS wind_speed_ms,
 (mm > 0 AND value - 5.0::DOUBLE <= 0) AS freezing_rain_flag
FROM (SELECT *, CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE (k % 20)/10.0::DOUBLE END AS mm FROM events_k)""")

_view("road_links", [], """
SELECT 'E'||lpad(p::VARCHAR, 12, '0') AS edge_id, CASE WHEN p_size % 2 = 0 THEN p_brand END AS corridor_name,
 'S'||prev::VARCHAR AS stop_id_prev, 'S'||cur::VARCHAR AS stop_id_curr,
 CASE WHEN p % 4 = 0 THEN 'S'||((prev+1) % 100)::VARCHAR END AS slug_prev,
 CASE WHEN p % 4 = 0 THEN 'S'||((cur+2) % 100)::VARCHAR END AS slug_curr,
 len AS segment_length_meters, round(len * (1.0::DOUBLE + (p_size % 10)/20.0::DOUBLE), 1) AS actual_path_length_meters,
 1.0::DOUBLE + (p_size % 10)/20.0::DOUBLE AS tortuosity_ratio, (p_size % 6)::BIGINT AS signalized_intersection_count,
 p_size % 3 = 0 AS is_dedicated_right_of_way, (p_size % 3 + 1)::BIGINT AS lane_capacity
FROM (SELECT *, p_partkey AS p, p_partkey % 100 AS prev,
 (p_partkey % 100 + (p_partkey // 100) % 23 + 89) % 100 AS cur, round(p_retailprice/2.0::DOUBLE, 1) AS len FROM part)""")

_view("stop_hubs", [], """
SELECT 'S'||(s_suppkey % 100)::VARCHAR AS stop_id,
 CASE WHEN s_suppkey % 5 = 0 THEN 'S'||((s_suppkey+7) % 100)::VARCHAR END AS zbk_slug, s_suppkey AS hub_no,
 (s_nationkey + 1)::BIGINT AS interchange_line_count,
 CASE WHEN s_nationkey % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS is_metro_proximity FROM supplier""")

_view("network_links", ["road_links"], """
SELECT * FROM road_links QUALIFY row_number() OVER (PARTITION BY stop_id_prev, stop_id_curr ORDER BY edge_id DESC) = 1""")

_view("network_hubs", ["stop_hubs"], """
SELECT * FROM stop_hubs QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY hub_no DESC) = 1""")

_view("service_days", ["trips"], "SELECT DISTINCT service_date::DATE AS day FROM trips")


def calendar_sql(days: str) -> str:
    """Calendar flags of a table with a ``day`` column, by the classic Easter computation."""
    holiday = """(strftime({d}, '%m-%d') IN ('01-01','01-06','05-01','05-03','08-15','11-01','11-11','12-25','12-26')
      OR {d} IN (easter, easter + 1, easter + 49, easter + 60))"""
    return f"""
SELECT day::VARCHAR AS calendar_date,
 CASE WHEN dayofweek(day) IN (0, 6) OR {holiday.format(d='day')} OR month(day) IN (7, 8)
  OR (month(day) = 6 AND day(day) >= 25) OR (month(day) = 12 AND day(day) >= 23)
  OR day BETWEEN DATE '2024-01-15' AND DATE '2024-01-28' OR day BETWEEN DATE '2025-02-03' AND DATE '2025-02-16'
  OR day BETWEEN DATE '2026-01-19' AND DATE '2026-02-01' OR day BETWEEN DATE '2027-01-18' AND DATE '2027-01-31'
  OR day BETWEEN easter - 3 AND easter + 2 OR (month(day) = 10 AND day(day) = 14) THEN 0 ELSE 1 END AS is_school_day,
 {holiday.format(d='day')}::INTEGER AS is_public_holiday,
 (dayofweek(day) BETWEEN 1 AND 5 AND {holiday.format(d='(day + 1)')})::INTEGER AS is_holiday_eve
FROM (SELECT day, make_date(y, (h + l - 7*m + 114)//31, (h + l - 7*m + 114) % 31 + 1) AS easter
 FROM (SELECT *, (a + 11*h + 22*l)//451 AS m
 FROM (SELECT *, (32 + 2*e + 2*(c//4) - h - c % 4) % 7 AS l
 FROM (SELECT *, (19*a + b - b//4 - (b - (b+8)//25 + 1)//3 + 15) % 30 AS h, b % 4 AS e
 FROM (SELECT day, year(day) AS y, year(day) % 19 AS a, year(day)//100 AS b, year(day) % 100 AS c FROM {days})))))"""


_view("calendar", ["service_days"], calendar_sql("service_days"))


def with_views(names: list[str], sql: str, extra: list[tuple[str, str]] = ()) -> str:
    """Prefix ``sql`` with the named views and what they need, then the extra steps."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    steps = [(n, VIEWS[n][1]) for n in order] + list(extra)
    if not steps:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in steps) + "\n" + sql

_HHMMSS = "format('{{:02d}}:{{:02d}}:{{:02d}}', ({s})//3600, (({s})//60) % 60, ({s}) % 60)"

_view("schedule_trips", ["trips"], """SELECT trip_id, route_id, brigade, trip_no, start_sec, service_date,
 CASE WHEN dayofweek(service_date::DATE) IN (0, 6) THEN 'WE' ELSE 'WD' END AS service_id FROM trips""")

_view("stop_times", ["trips", "latest_lines"], f"""
SELECT trip_id, l_linenumber AS stop_sequence, 'S'||((r*5 + l_partkey % 12) % 100)::VARCHAR AS stop_id,
 {_HHMMSS.format(s='start_sec + l_linenumber*150')} AS arrival_time,
 {_HHMMSS.format(s='start_sec + l_linenumber*150 + (l_quantity::INTEGER % 4)*10')} AS departure_time
FROM latest_lines JOIN trips ON l_orderkey = trip_no""")

_view("stops", ["stop_times"], """
SELECT stop_id, 'Stop '||n::VARCHAR AS stop_name, 52.1::DOUBLE + n*0.002::DOUBLE AS stop_lat,
 20.9::DOUBLE + (n % 10)*0.003::DOUBLE AS stop_lon
FROM (SELECT DISTINCT stop_id, substring(stop_id, 2)::INTEGER AS n FROM stop_times)""")

_view("vehicle_fixes", ["trips", "latest_lines"], f"""
SELECT service_date, vehicle_type, CASE WHEN l_suppkey % 11 = 0 THEN 'X1' ELSE vehicle_id END AS vehicle_number, route_id, brigade,
 52.1::DOUBLE + n*0.002::DOUBLE + (CASE WHEN l_suppkey % 13 = 0 THEN 70 ELSE (l_partkey % 5)*8 END)/111271.72::DOUBLE AS lat,
 20.9::DOUBLE + (n % 10)*0.003::DOUBLE + j*11/68325.49::DOUBLE AS lon, gps AS gps_timestamp_utc,
 gps + CASE WHEN l_partkey % 50 = 0 THEN 400 WHEN l_partkey % 50 = 1 THEN 3600 ELSE q % 5 END AS tick_ts, trip_id,
 strftime(timezone('Europe/Warsaw', to_timestamp(gps)), '%Y-%m-%d %H:%M:%S') AS gps_time_str
FROM (SELECT *, (r*5 + l_partkey % 12) % 100 AS n, day_epoch + start_sec + l_linenumber*150 + delay + j*12 AS gps
 FROM ({_LINE} FROM latest_lines) JOIN trips ON l_orderkey = trip_no CROSS JOIN (SELECT unnest(range(-3, 4)) AS j))""")

_view("raw_pings", ["events_k"], """
SELECT 'all' AS service_date, CASE WHEN user_id % 3 = 0 THEN 'tram' ELSE 'bus' END AS vehicle_type, (user_id % 40)::VARCHAR AS vehicle_number,
 '190' AS route_id, '1' AS brigade, 52.2::DOUBLE + (k % 2)*0.001::DOUBLE AS lat, 21.0::DOUBLE + (k % 3)*0.0001::DOUBLE AS lon,
 (epoch // 43200)*43200 AS gps_timestamp_utc, ((epoch // 43200)*43200)::VARCHAR AS gps_time_str, epoch AS tick_ts FROM events_k""")
