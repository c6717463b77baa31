"""Registered queries: links, shapes, signals, corridors, hubs and stop registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import network as nw
from fleetlens.plans import domain
from fleetlens.plans.registry import comparable, query
from fleetlens.plans.views_sql import with_views

STREETS = ["Al. Jerozolimskie", "Puławska", "al. SOLIDARNOŚCI", "Towarowa", "Okopowa", "Łazienkowska", "Wawelska", "Radzymińska", "Górczewska",
           "Modlińska", "Wisłostrada", "Prosta", "Marszałkowska", "al. Jana Pawła II", "Mickiewicza"]
_STREET = "list_extract([" + ", ".join(f"'{s}'" for s in STREETS) + "], n % 15 + 1)"
STOPS = ("named_stops", f"SELECT *, {_STREET} AS street, 1 + n % 5 // 4 AS zone_id FROM (SELECT *, substring(stop_id, 2)::INTEGER AS n FROM stops)")
SIGNALS = ("signals", "SELECT c_custkey AS osmid, 52.1::DOUBLE + (c_custkey*7919 % 2000)*0.0001::DOUBLE AS lat, 20.9::DOUBLE + (c_custkey*104729 % 300)*0.0001::DOUBLE AS lon FROM customer")
ROUTED = ("routed", "SELECT trip_id, route_id, CASE WHEN route_id IN ('2', '4') THEN 0 ELSE 3 END AS route_type FROM trips")


def named_stops(spark, sf):
    n = F.substring("stop_id", 2, 10).cast("int")
    street = F.get(F.array(*[F.lit(s) for s in STREETS]), n % 15)
    return domain.stops(spark, sf).withColumns({"street": street, "zone_id": F.lit(1) + F.floor((n % 5) / F.lit(4)).cast("int")})


def signals(spark, sf):
    k = F.col("c_custkey")
    return domain.table(spark, sf, "customer").select(
        k.alias("osmid"), (F.lit(52.1) + (k * 7919 % 2000) * F.lit(0.0001)).alias("lat"), (F.lit(20.9) + (k * 104729 % 300) * F.lit(0.0001)).alias("lon"))


def routed_trips(spark, sf):
    return domain.trips(spark, sf).select("trip_id", "route_id", F.when(F.col("route_id").isin("2", "4"), 0).otherwise(3).alias("route_type"))


LINKS = [ROUTED, ("links", """SELECT stop_id_prev, stop_id_curr, max(CASE WHEN route_type = 0 OR TRY_CAST(route_id AS INTEGER) < 100 THEN 1 ELSE 0 END)::BIGINT AS is_tram_link FROM (
  SELECT lag(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS stop_id_prev, stop_id AS stop_id_curr, route_id, route_type FROM stop_times JOIN routed USING (trip_id)) WHERE stop_id_prev IS NOT NULL GROUP BY 1, 2""")]


@query("w14_a15_scheduled_links", with_views(["stop_times"], "SELECT * FROM links", LINKS))
def scheduled_links(spark, sf):
    return comparable(nw.scheduled_links(domain.stop_times(spark, sf), routed_trips(spark, sf)))


SHAPES = ("shapes", """SELECT DISTINCT 'SH'||r::VARCHAR AS shape_id, a*2 + h AS shape_pt_sequence, 52.1::DOUBLE + n*0.002::DOUBLE + h*0.001::DOUBLE AS lat, 20.9::DOUBLE + (n % 10)*0.003::DOUBLE + h*0.0015::DOUBLE AS lon
  FROM (SELECT r, l_partkey % 12 AS a, (r*5 + l_partkey % 12) % 100 AS n, unnest([0, 1]) AS h FROM latest_lines JOIN trips ON l_orderkey = trip_no)""")


def shapes(spark, sf):
    rows = domain.trip_lines(spark, sf)
    a = F.col("l_partkey") % 12
    n = (F.col("r") * 5 + a) % 100
    h = F.col("h")
    return rows.withColumn("h", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat(F.lit("SH"), F.col("r").cast("string")).alias("shape_id"), (a * 2 + h).alias("shape_pt_sequence"),
        (F.lit(52.1) + n * F.lit(0.002) + h * F.lit(0.001)).alias("lat"), (F.lit(20.9) + (n % 10) * F.lit(0.003) + h * F.lit(0.0015)).alias("lon")).distinct()


def shaped_trips(spark, sf):
    return domain.trips(spark, sf).select("trip_id", F.concat(F.lit("SH"), F.col("r").cast("string")).alias("shape_id"))


_GC = "2*6371000.0::DOUBLE*atan2(sqrt({a}), sqrt(1-{a}))"


def _hav(lat1, lon1, lat2, lon2):
    return _GC.format(a=f"(pow(sin(radians({lat2}-{lat1})/2),2) + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2))")


CUM = ("cum", f"""SELECT *, sum(COALESCE(step, 0)) OVER (PARTITION BY shape_id ORDER BY ix) AS cum FROM (SELECT *, row_number() OVER w - 1 AS ix,
  {_hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step FROM shapes WINDOW w AS (PARTITION BY shape_id ORDER BY shape_pt_sequence))""")


@query("w16_shape_distance", with_views(["latest_lines", "trips"], "SELECT shape_id, shape_pt_sequence, ix, round(cum, 4) + 0.0 AS cum FROM cum", [SHAPES, CUM]))
def shape_distance(spark, sf):
    return comparable(nw.shape_distances(shapes(spark, sf)).select("shape_id", "shape_pt_sequence", "ix", "cum"), 4)


PATHS = [SHAPES, CUM,
    ("served", """SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY seq, stop_id) AS k FROM (SELECT DISTINCT 'SH'||r::VARCHAR AS shape_id, stop_id, stop_sequence AS seq FROM stop_times JOIN trips USING (trip_id))"""),
    ("placed", "SELECT served.*, stop_lat, stop_lon FROM served JOIN stops USING (stop_id)"),
    ("snaps", """SELECT shape_id, 0::BIGINT AS k, 0::BIGINT AS ix, NULL::VARCHAR AS stop_id, NULL::DOUBLE AS reached FROM (SELECT DISTINCT shape_id FROM cum)
      UNION ALL SELECT s.shape_id, s.k + 1, b.ix, b.stop_id, b.cum FROM snaps s, LATERAL (SELECT c.ix, c.cum, p.stop_id FROM placed p JOIN cum c ON c.shape_id = p.shape_id
       WHERE p.shape_id = s.shape_id AND p.k = s.k + 1 AND c.ix >= s.ix ORDER BY pow(c.lat - p.stop_lat, 2) + pow(c.lon - p.stop_lon, 2), c.ix LIMIT 1) b"""),
    ("paths", """SELECT stop_id_prev, stop_id_curr, median(m) AS actual_path_length_meters FROM (SELECT lag(stop_id) OVER w AS stop_id_prev, stop_id AS stop_id_curr, reached - lag(reached) OVER w AS m
       FROM snaps WHERE k > 0 WINDOW w AS (PARTITION BY shape_id ORDER BY k)) WHERE stop_id_prev IS NOT NULL AND m >= 0 GROUP BY 1, 2""")]


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("c12_path_lengths", recursive(with_views(["stop_times", "latest_lines", "trips", "stops"],
       "SELECT stop_id_prev, stop_id_curr, round(actual_path_length_meters, 4) + 0.0 AS actual_path_length_meters FROM paths", PATHS)))
def path_lengths(spark, sf):
    return comparable(nw.path_lengths(shapes(spark, sf), shaped_trips(spark, sf), domain.stop_times(spark, sf), domain.stops(spark, sf)), 4)


def _ends(links: str) -> str:
    return f"""SELECT l.*, a.stop_name AS name1, a.stop_lat AS lat1, a.stop_lon AS lon1, a.street AS st1, b.stop_name AS name2, b.stop_lat AS lat2, b.stop_lon AS lon2, b.street AS st2
      FROM {links} l JOIN named_stops a ON a.stop_id = stop_id_prev JOIN named_stops b ON b.stop_id = stop_id_curr"""


def _buffered(ends: str, ky: str, kx: str, reach: str) -> list[tuple[str, str]]:
    return [
        ("segs", f"SELECT stop_id_prev, stop_id_curr, lon1*{kx} AS x1, lat1*{ky} AS y1, lon2*{kx} AS x2, lat2*{ky} AS y2 FROM {ends}"),
        ("pts", f"SELECT lon*{kx} AS px, lat*{ky} AS py FROM signals"),
        ("near", f"""SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE greatest(0.0, least(1.0, ((px-x1)*(x2-x1) + (py-y1)*(y2-y1))/((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)))) END AS t FROM segs JOIN pts
          ON px BETWEEN least(x1,x2) - {reach} AND greatest(x1,x2) + {reach} AND py BETWEEN least(y1,y2) - {reach} AND greatest(y1,y2) + {reach}"""),
        ("counted", f"""SELECT stop_id_prev, stop_id_curr, count(*) AS n FROM near WHERE (x1 = x2 AND y1 = y2) OR pow(px-(x1+t*(x2-x1)),2) + pow(py-(y1+t*(y2-y1)),2) <= {reach}*{reach} GROUP BY 1, 2"""),
    ]


METRIC = ("111194.9::DOUBLE", "(111194.9::DOUBLE*cos(radians(52.23::DOUBLE)))", "35.0::DOUBLE")
BUFFER = [*LINKS, STOPS, SIGNALS, ("ends", _ends("links")), *_buffered("ends", *METRIC)]


@query("j18_signals_near_links", with_views(["stop_times", "stops", "trips"], """SELECT stop_id_prev, stop_id_curr, COALESCE(n, 0)::BIGINT AS signalized_intersection_count
  FROM ends LEFT JOIN counted USING (stop_id_prev, stop_id_curr)""", BUFFER))
def signals_near(spark, sf):
    links = nw.with_end_points(nw.scheduled_links(domain.stop_times(spark, sf), routed_trips(spark, sf)), named_stops(spark, sf), ["stop_lat", "stop_lon"])
    return comparable(nw.signals_near_links(links, signals(spark, sf)).select("stop_id_prev", "stop_id_curr", "signalized_intersection_count"))


def _rules() -> str:
    name, row, lanes = "", "", ""
    for c, both, one, own, n in nw.CORRIDOR_RULES:
        tests = [f"contains(lower(st1), '{w}') OR contains(lower(st2), '{w}')" for w in both] + [f"contains(lower(st1), '{w}')" for w in one]
        hit = " OR ".join(tests)
        name += f" WHEN {hit} THEN '{c}'"
        row += f" WHEN {hit} THEN {'is_tram_link = 1' if own is None else str(own).lower()}"
        lanes += f" WHEN {hit} THEN {n}"
    return f"CASE{name} END AS corridor_name, (CASE{row} ELSE is_tram_link = 1 END) OR is_tram_link = 1 AS is_dedicated_right_of_way, CASE{lanes} WHEN len < 1500 THEN 2 ELSE 3 END::BIGINT AS lane_capacity"


CITY = [*PATHS, *BUFFER, ("city", f"""SELECT stop_id_prev||'_'||stop_id_curr AS edge_id, stop_id_prev, stop_id_curr, name1 AS stop_name_prev, name2 AS stop_name_curr, len AS segment_length_meters, act AS actual_path_length_meters,
   round_even(act/greatest(len, 1.0), 3) AS tortuosity_ratio, sig AS signalized_intersection_count, {_rules()} FROM (SELECT *, CASE WHEN p IS NULL OR p < len THEN len ELSE round_even(p, 1) END AS act FROM (
   SELECT e.*, round_even({_hav('lat1', 'lon1', 'lat2', 'lon2')}, 1) AS len, p.actual_path_length_meters AS p, COALESCE(n, 0)::BIGINT AS sig FROM ends e
    LEFT JOIN paths p USING (stop_id_prev, stop_id_curr) LEFT JOIN counted USING (stop_id_prev, stop_id_curr)))""")]


@query("c11_citywide_links", recursive(with_views(["stop_times", "latest_lines", "trips", "stops"], "SELECT * FROM city", CITY)))
def citywide(spark, sf):
    st, stops = domain.stop_times(spark, sf), named_stops(spark, sf)
    paths = nw.path_lengths(shapes(spark, sf), shaped_trips(spark, sf), st, stops)
    return comparable(nw.citywide_links(st, stops, signals(spark, sf), routed_trips(spark, sf), paths))


CORRIDOR = [STOPS, SIGNALS,
    ("on_corridor", " UNION ALL ".join(f"SELECT *, '{c}' AS corridor_name, {i} AS rk, {n} AS lanes FROM named_stops WHERE zone_id = 1 AND regexp_matches(street, '{p}', 'i')" for i, (c, p, _, n) in enumerate(nw.STUDY_CORRIDORS))),
    ("links", """SELECT DISTINCT stop_id AS stop_id_prev, nxt AS stop_id_curr FROM (SELECT stop_id, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS nxt FROM stop_times)
      WHERE stop_id IN (SELECT stop_id FROM on_corridor) AND nxt IN (SELECT stop_id FROM on_corridor)"""),
    ("ends", _ends("links")), *_buffered("ends", "1.0::DOUBLE", "1.0::DOUBLE", "0.00035::DOUBLE")]


@query("p17_corridor_stops", with_views(["stops"], "SELECT stop_id, street, corridor_name FROM on_corridor", CORRIDOR[:1] + CORRIDOR[2:3]))
def corridor_stops(spark, sf):
    return nw.corridor_stops(named_stops(spark, sf)).select("stop_id", "street", "corridor_name")


@query("j21_corridor_pairs", with_views(["stops", "stop_times"], "SELECT * FROM links", CORRIDOR[:1] + CORRIDOR[2:4]))
def corridor_pairs(spark, sf):
    return nw.corridor_pairs(domain.stop_times(spark, sf), nw.corridor_stops(named_stops(spark, sf))).select("stop_id_prev", "stop_id_curr")


@query("c13_corridor_links", with_views(["stops", "stop_times"], f"""SELECT stop_id_prev||'_'||stop_id_curr AS edge_id, c.corridor_name, stop_id_prev, stop_id_curr, name1 AS stop_name_prev, name2 AS stop_name_curr,
  round_even({_hav('lat1', 'lon1', 'lat2', 'lon2')}, 1) AS segment_length_meters, round_even({_hav('lat1', 'lon1', 'lat2', 'lon2')}, 1) AS actual_path_length_meters, 1.0::DOUBLE AS tortuosity_ratio,
  true AS is_dedicated_right_of_way, COALESCE(n, 0)::BIGINT AS signalized_intersection_count, lanes::BIGINT AS lane_capacity FROM ends e LEFT JOIN counted USING (stop_id_prev, stop_id_curr)
  JOIN (SELECT stop_id, max_by(corridor_name, rk) AS corridor_name, max_by(lanes, rk) AS lanes FROM on_corridor GROUP BY 1) c ON c.stop_id = stop_id_prev""", CORRIDOR))
def corridor_links(spark, sf):
    return comparable(nw.corridor_links(domain.stop_times(spark, sf), named_stops(spark, sf), signals(spark, sf)))


_STATIONS = "(VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in nw.METRO_STATIONS) + ") m(mlat, mlon)"
HUB_SQL = [("wide", "SELECT stop_id, stop_name, stop_lat, 20.9::DOUBLE + (stop_lon - 20.9::DOUBLE)*6 AS stop_lon FROM stops"),
    ("lines", "SELECT stop_id, count(DISTINCT route_id) AS n FROM stop_times JOIN trips USING (trip_id) GROUP BY 1"),
    ("dist", f"SELECT stop_id, min({_hav('stop_lat', 'stop_lon', 'mlat', 'mlon')}) AS m FROM wide, {_STATIONS} GROUP BY 1")]


def wide_stops(spark, sf):
    return domain.stops(spark, sf).withColumn("stop_lon", F.lit(20.9) + (F.col("stop_lon") - F.lit(20.9)) * 6)


@query("c15_stop_hubs", with_views(["stops", "stop_times", "trips"], """SELECT stop_id, stop_name, COALESCE(n, 1)::BIGINT AS interchange_line_count, (m <= 300)::BIGINT AS is_metro_proximity, round_even(m, 1) AS min_dist_to_metro_m,
  (COALESCE(n, 1) >= 10 OR m <= 300)::BIGINT AS is_major_transfer_hub FROM wide JOIN dist USING (stop_id) LEFT JOIN lines USING (stop_id)""", HUB_SQL))
def hubs(spark, sf):
    return comparable(nw.stop_hubs(wide_stops(spark, sf), domain.stop_times(spark, sf), domain.trips(spark, sf)))


@query("a4_routes_per_stop", with_views(["stop_times", "trips"], "SELECT stop_id, count(DISTINCT route_id) AS n_lines FROM stop_times JOIN trips USING (trip_id) GROUP BY 1"))
def routes_per_stop(spark, sf):
    return domain.stop_times(spark, sf).join(domain.trips(spark, sf), "trip_id").groupBy("stop_id").agg(F.countDistinct("route_id").alias("n_lines"))


REGISTERS = [
    ("ztm", "SELECT (s_suppkey + 700000)::VARCHAR AS stop_id, 'Plac '||s_name AS stop_name, 52.0::DOUBLE + s_suppkey*0.001::DOUBLE AS stop_lat, 21.0::DOUBLE + s_nationkey*0.01::DOUBLE AS stop_lon, s_suppkey AS n FROM supplier"),
    ("zbk", """SELECT 'c-'||s_suppkey::VARCHAR AS stop_id, CASE WHEN s_suppkey % 2 = 0 THEN 'plac. '||lower(s_name) ELSE s_name END AS stop_name, (s_suppkey % 100)::VARCHAR AS stop_code,
      52.0::DOUBLE + s_suppkey*0.001::DOUBLE + CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE 0.5 END AS stop_lat, 21.0::DOUBLE + s_nationkey*0.01::DOUBLE AS stop_lon FROM supplier"""),
    ("za", "SELECT *, lpad(right(stop_id, 2), 2, '0') AS post_code, round_even(stop_lat, 5) AS lat5, round_even(stop_lon, 5) AS lon5, regexp_replace(translate(lower(stop_name), 'ąćęłńóśźż', 'acelnoszz'), '[^a-z0-9]', '', 'g') AS nn FROM ztm"),
    ("zb", "SELECT *, lpad(stop_code, 2, '0') AS post_code, round_even(stop_lat, 5) AS lat5, round_even(stop_lon, 5) AS lon5, regexp_replace(translate(lower(stop_name), 'ąćęłńóśźż', 'acelnoszz'), '[^a-z0-9]', '', 'g') AS nn FROM zbk"),
    ("m1", "SELECT a.stop_id AS ztm_id, b.stop_id AS zbk_slug, a.stop_name AS ztm_name, b.stop_name AS canonical_name, a.post_code, b.stop_lat, b.stop_lon, 'coord_and_post' AS match_method FROM za a JOIN zb b USING (lat5, lon5, post_code)"),
    ("m2", """SELECT a.stop_id, b.stop_id, a.stop_name, b.stop_name, a.post_code, b.stop_lat, b.stop_lon, 'name_and_post' FROM za a JOIN zb b USING (nn, post_code)
      WHERE a.stop_id NOT IN (SELECT ztm_id FROM m1) AND b.stop_id NOT IN (SELECT zbk_slug FROM m1)"""),
    ("mapping", "SELECT * FROM m1 UNION ALL SELECT * FROM m2")]


def registers(spark, sf):
    s = domain.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    lat, lon = F.lit(52.0) + k * F.lit(0.001), F.lit(21.0) + F.col("s_nationkey") * F.lit(0.01)
    ztm = s.select((k + 700000).cast("string").alias("stop_id"), F.concat(F.lit("Plac "), "s_name").alias("stop_name"), lat.alias("stop_lat"), lon.alias("stop_lon"))
    zbk = s.select(F.concat(F.lit("c-"), k.cast("string")).alias("stop_id"),
                   F.when(k % 2 == 0, F.concat(F.lit("plac. "), F.lower("s_name"))).otherwise(F.col("s_name")).alias("stop_name"),
                   (k % 100).cast("string").alias("stop_code"), (lat + F.when(k % 3 == 0, 0.0).otherwise(0.5)).alias("stop_lat"), lon.alias("stop_lon"))
    return ztm, zbk


@query("j15_canonical_stops", with_views([], "SELECT ztm_id, zbk_slug, ztm_name, canonical_name, post_code, round(stop_lat, 6) AS stop_lat, round(stop_lon, 6) AS stop_lon, match_method FROM mapping", REGISTERS))
def canonical(spark, sf):
    return comparable(nw.canonical_stops(*registers(spark, sf)))


SLUGGED = [*REGISTERS, ("lk", "SELECT (p_partkey % 120 + 700000)::VARCHAR AS stop_id_prev, (p_partkey % 77 + 700000)::VARCHAR AS stop_id_curr, p_partkey FROM part"),
    ("slugged", "SELECT p_partkey, stop_id_prev, stop_id_curr, a.zbk_slug AS slug_prev, b.zbk_slug AS slug_curr FROM lk LEFT JOIN mapping a ON a.ztm_id = stop_id_prev LEFT JOIN mapping b ON b.ztm_id = stop_id_curr")]


def slugged(spark, sf):
    k = F.col("p_partkey")
    links = domain.table(spark, sf, "part").select(k, (k % 120 + 700000).cast("string").alias("stop_id_prev"), (k % 77 + 700000).cast("string").alias("stop_id_curr"))
    return nw.links_with_slugs(links, nw.canonical_stops(*registers(spark, sf)))


@query("j16_links_with_slugs", with_views([], "SELECT * FROM slugged", SLUGGED))
def links_with_slugs(spark, sf):
    return slugged(spark, sf).select("p_partkey", "stop_id_prev", "stop_id_curr", "slug_prev", "slug_curr")


@query("j16_match_rate", with_views([], """SELECT count(*) AS total, count(*) FILTER (slug_prev IS NOT NULL AND slug_curr IS NOT NULL) AS mapped,
  round(count(*) FILTER (slug_prev IS NOT NULL AND slug_curr IS NOT NULL)*100.0::DOUBLE/count(*), 6) AS mapped_pct FROM slugged""", SLUGGED))
def slug_rate(spark, sf):
    return comparable(nw.match_rate(slugged(spark, sf), ["slug_prev", "slug_curr"]))


@query("j24_shared_vehicles", with_views(["vehicle_fixes", "stop_updates"], """SELECT (SELECT count(DISTINCT vehicle_number) FROM vehicle_fixes) AS left_codes, (SELECT count(DISTINCT vehicle_id) FROM stop_updates) AS right_codes,
  (SELECT count(*) FROM (SELECT DISTINCT vehicle_number FROM vehicle_fixes) WHERE vehicle_number IN (SELECT vehicle_id FROM stop_updates)) AS common_codes"""))
def shared_vehicles(spark, sf):
    return nw.shared_codes(domain.vehicle_fixes.view(spark, sf), domain.stop_updates.view(spark, sf).withColumnRenamed("vehicle_id", "vehicle_number"), "vehicle_number")


LINEAR = [SHAPES, ("pl", "SELECT *, (lon - 21.01::DOUBLE)*68325.49::DOUBLE AS x, (lat - 52.23::DOUBLE)*111271.72::DOUBLE AS y FROM shapes"),
    ("sg0", "SELECT shape_id, row_number() OVER w - 1 AS seg, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pl WINDOW w AS (PARTITION BY shape_id ORDER BY shape_pt_sequence)"),
    ("sg1", "SELECT *, sqrt(pow(x2-x1,2) + pow(y2-y1,2)) AS len FROM sg0 WHERE x2 IS NOT NULL"),
    ("sg", "SELECT *, sum(len) OVER (PARTITION BY shape_id ORDER BY seg) - len AS s0 FROM sg1"),
    ("fx", "SELECT event_id, 'SH'||(user_id % 30)::VARCHAR AS shape_id, (20.9::DOUBLE + (k % 30)*0.001::DOUBLE - 21.01::DOUBLE)*68325.49::DOUBLE AS px, (52.1::DOUBLE + k*0.002::DOUBLE - 52.23::DOUBLE)*111271.72::DOUBLE AS py FROM events_k"),
    ("pr", """SELECT event_id, seg, s0 + t*len AS along, pow(px-(x1+t*(x2-x1)),2) + pow(py-(y1+t*(y2-y1)),2) AS d2 FROM (SELECT *, CASE WHEN len*len <= 0.000001 THEN 0 ELSE greatest(0.0, least(1.0, ((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/(pow(x2-x1,2)+pow(y2-y1,2)))) END AS t
       FROM fx JOIN sg USING (shape_id))""")]


@query("c14_along_shape", with_views(["latest_lines", "trips", "events_k"], """SELECT event_id, round(along, 3) + 0.0 AS along_m, round(sqrt(d2), 3) + 0.0 AS cross_m FROM pr QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(d2, 6), seg) = 1""", LINEAR))
def along(spark, sf):
    e = domain.events_k(spark, sf).select("event_id", F.concat(F.lit("SH"), (F.col("user_id") % 30).cast("string")).alias("shape_id"),
                                          (F.lit(52.1) + F.col("k") * F.lit(0.002)).alias("lat"), (F.lit(20.9) + (F.col("k") % 30) * F.lit(0.001)).alias("lon"))
    return comparable(nw.along_shape(e, shapes(spark, sf)).select("event_id", "along_m", "cross_m"), 3)


@query("c16_snapshot_for_day", """SELECT 'SN'||n::VARCHAR AS snapshot_id, c AS n_services, f AS feed_start FROM (SELECT o_custkey % 6 AS n, count(*) FILTER (day(o_orderdate) = 7) AS c, strftime(min(o_orderdate), '%Y%m%d') AS f FROM orders GROUP BY 1)
  ORDER BY CASE WHEN c >= 10 THEN 2 WHEN c > 0 THEN 1 ELSE 0 END DESC, CASE WHEN c BETWEEN 1 AND 9 THEN c ELSE 0 END DESC, f DESC, n DESC LIMIT 1""")
def snapshot(spark, sf):
    o = domain.table(spark, sf, "orders").withColumn("snapshot_id", F.concat(F.lit("SN"), (F.col("o_custkey") % 6).cast("string")))
    snaps = o.groupBy("snapshot_id").agg(F.date_format(F.min(F.to_date("o_orderdate")), "yyyyMMdd").alias("feed_start"), F.lit(0).alias("fetched_at"))
    services = o.select("snapshot_id", F.when(F.dayofmonth("o_orderdate") == 7, "20261007").otherwise("other").alias("date"))
    return nw.snapshot_for_day(snaps, services, "2026-10-07")


@query("c16_snapshots_by_day", """WITH o AS (SELECT 'SN'||(o_custkey % 6)::VARCHAR AS snapshot_id, o_orderdate::DATE AS d FROM orders),
 snaps AS (SELECT snapshot_id, min(d) AS feed_start FROM o GROUP BY 1),
 per AS (SELECT d, snapshot_id, count(*) AS n FROM o WHERE month(d) <> 6 GROUP BY 1, 2),
 best AS (SELECT d, arg_max({s: snapshot_id, n: n}, (n >= 10, CASE WHEN n < 10 THEN n ELSE 0 END, feed_start, snapshot_id)) AS b FROM per JOIN snaps USING (snapshot_id) GROUP BY 1)
 SELECT strftime(o.d, '%Y-%m-%d') AS service_date, COALESCE(b.s, (SELECT arg_max(snapshot_id, (feed_start, snapshot_id)) FROM snaps)) AS snapshot_id, COALESCE(b.n, 0)::BIGINT AS n_services
 FROM (SELECT DISTINCT d FROM o) o LEFT JOIN best USING (d)""")
def snapshots_by_day(spark, sf):
    o = domain.table(spark, sf, "orders").select(F.concat(F.lit("SN"), (F.col("o_custkey") % 6).cast("string")).alias("snapshot_id"), F.to_date("o_orderdate").alias("d"))
    snaps = o.groupBy("snapshot_id").agg(F.date_format(F.min("d"), "yyyyMMdd").alias("feed_start"), F.lit(0).alias("fetched_at"))
    services = o.filter(F.month("d") != 6).select("snapshot_id", F.date_format("d", "yyyyMMdd").alias("date"))
    return nw.snapshots_by_day(snaps, services, o.select(F.date_format("d", "yyyy-MM-dd").alias("service_date")))


@query("c17_new_snapshots", """SELECT md5(source||lang) AS sha256, min(doc_id) AS fetched_at_utc FROM documents WHERE md5(source||lang) NOT IN (SELECT md5(source||lang) FROM documents WHERE doc_id < 20) GROUP BY 1""")
def new_snapshots(spark, sf):
    d = domain.table(spark, sf, "documents").select(F.md5(F.concat("source", "lang")).alias("sha256"), F.col("doc_id").alias("fetched_at_utc"))
    return nw.new_snapshots(d.filter("fetched_at_utc < 20"), d)
