"""Road and stop network: links, path lengths along shapes, signals, corridors, hubs, stop ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import geo, transit
from fleetlens.functions.rounding import round_half_even

BUFFER_M = 35.0
BUFFER_DEG = 0.00035
CELL_M = 500.0
METRO_RADIUS_M = 300.0
HUB_LINES = 10
BUFFER_LAT_0 = 52.23

# Metro stations as (latitude, longitude), line 1 from south to north, then line 2
# from west to east.
METRO_STATIONS = [
    (52.1308, 21.0650), (52.1397, 21.0569), (52.1494, 21.0456), (52.1539, 21.0347), (52.1628, 21.0283),
    (52.1728, 21.0267), (52.1814, 21.0222), (52.1903, 21.0150), (52.1994, 21.0117), (52.2089, 21.0092),
    (52.2189, 21.0175), (52.2308, 21.0108), (52.2356, 21.0083), (52.2450, 21.0017), (52.2575, 20.9983),
    (52.2625, 20.9842), (52.2683, 20.9708), (52.2722, 20.9575), (52.2783, 20.9472), (52.2842, 20.9392),
    (52.2905, 20.9300),
    (52.2392, 20.9125), (52.2411, 20.9286), (52.2400, 20.9442), (52.2378, 20.9606), (52.2325, 20.9678),
    (52.2303, 20.9839), (52.2325, 20.9989), (52.2369, 21.0183), (52.2403, 21.0319), (52.2467, 21.0436),
    (52.2547, 21.0356), (52.2617, 21.0417), (52.2689, 21.0506), (52.2742, 21.0578), (52.2856, 21.0583),
    (52.2925, 21.0431), (52.2958, 21.0256),
]
# Study corridors as (id, street pattern, right of way, lanes).
STUDY_CORRIDORS = [
    ("al_jerozolimskie", "Jerozolimsk", True, 3),
    ("pulawska", "Puławsk", True, 3),
    ("trasa_wz", "Solidarności", True, 2),
    ("towarowa_okopowa", "Towarow|Okopow", True, 3),
]
# City-wide corridor rules in order of precedence, as (id, keywords tested on both
# ends, keywords tested on the first end only, right of way or None for "trams only", lanes).
CORRIDOR_RULES = [
    ("al_jerozolimskie", ["jerozolimsk"], [], True, 3),
    ("pulawska", ["puławsk"], [], True, 3),
    ("trasa_wz", ["solidarnośc"], [], True, 2),
    ("towarowa_okopowa", ["towarow", "okopow"], [], True, 3),
    ("trasa_lazienkowska", ["łazienkowsk"], ["stanów zjednoczonych", "wawelsk"], True, 3),
    ("radzyminska", ["radzymińsk"], [], True, 3),
    ("gorczewska", ["górczewsk"], [], True, 3),
    ("modlinska", ["modlińsk"], [], True, 3),
    ("wislostrada", [], ["wisłostrad", "czerniakowsk", "wybrzeże"], False, 3),
    ("prosta_kasprzaka", [], ["kasprzak", "prost"], True, 3),
    ("marszalkowska", ["marszałkowsk"], [], None, 3),
    ("al_jana_pawla_ii", [], ["jana pawła", "chałubińsk", "niepodległoś"], None, 3),
]


def scheduled_links(stop_times: DataFrame, trips: DataFrame | None = None) -> DataFrame:
    """Directed stop pairs of the timetable, flagged when any tram uses them."""
    rows = stop_times.select("trip_id", F.col("stop_sequence").cast("int").alias("seq"), "stop_id")
    tram = F.lit(0)
    if trips is not None:
        rows = rows.join(trips.select("trip_id", "route_id", "route_type"), "trip_id")
        tram = transit.flag((F.col("route_type") == 0) | (F.col("route_id").try_cast("int") < 100))
    before = F.lag("stop_id").over(Window.partitionBy("trip_id").orderBy("seq"))
    pairs = rows.withColumns({"stop_id_prev": before, "stop_id_curr": F.col("stop_id"), "t": tram})
    return pairs.filter(F.col("stop_id_prev").isNotNull()).groupBy("stop_id_prev", "stop_id_curr").agg(
        F.max("t").alias("is_tram_link"))


def with_end_points(links: DataFrame, stops: DataFrame, columns: list[str]) -> DataFrame:
    """Attach stop columns of both ends as ``<col>_1`` and ``<col>_2``; unknown stops drop out."""
    for side, key in (("1", "stop_id_prev"), ("2", "stop_id_curr")):
        end = stops.select(F.col("stop_id").alias(key), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        links = links.join(end, key)
    return links


def link_length() -> Column:
    return geo.great_circle(F.col("stop_lat_1"), F.col("stop_lon_1"), F.col("stop_lat_2"), F.col("stop_lon_2"))


def shape_distances(shapes: DataFrame) -> DataFrame:
    """Shape points with position number and distance travelled along the shape."""
    along = Window.partitionBy("shape_id").orderBy("shape_pt_sequence")
    step = geo.great_circle(F.lag("lat").over(along), F.lag("lon").over(along), F.col("lat"), F.col("lon"))
    numbered = shapes.withColumns({"ix": F.row_number().over(along) - 1, "step": F.coalesce(step, F.lit(0.0))})
    return numbered.withColumn("cum", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


_SNAP = """aggregate(stops, named_struct('ix', 0, 'done', cast(array() as array<struct<stop_id: string, at: double>>)),
  (acc, s) -> transform(array(array_min(transform(filter(points, p -> p.ix >= acc.ix),
      p -> named_struct('d', pow(p.lat - s.lat, 2) + pow(p.lon - s.lon, 2), 'ix', p.ix, 'cum', p.cum)))),
    best -> named_struct('ix', if(s.lat is null, acc.ix, best.ix),
      'done', concat(acc.done, array(named_struct('stop_id', s.stop_id, 'at', if(s.lat is null, null, best.cum))))))[0],
  acc -> acc.done)"""


def path_lengths(shapes: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Median path length of each stop pair over all shapes that serve it.

    Per shape, stops snap in order to the nearest shape point at or after the previous snap. A
    shape is one drawn line with its stops, so one row per shape holds the fold's input.
    """
    points = shape_distances(shapes).groupBy("shape_id").agg(
        F.sort_array(F.collect_list(F.struct("ix", "lat", "lon", "cum"))).alias("points"))
    served = stop_times.join(trips.filter("shape_id is not null and shape_id != ''").select("trip_id", "shape_id"), "trip_id")
    served = served.select("shape_id", "stop_id", F.col("stop_sequence").cast("int").alias("seq")).distinct()
    placed = served.join(stops.select("stop_id", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon")), "stop_id", "left")
    visits = placed.groupBy("shape_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "stop_id", "lat", "lon"))).alias("stops"))
    snapped = points.join(visits, "shape_id").select("shape_id", F.posexplode(F.expr(_SNAP)).alias("n", "v"))
    w = Window.partitionBy("shape_id").orderBy("n")
    pairs = snapped.select(
        F.lag("v.stop_id").over(w).alias("stop_id_prev"), F.col("v.stop_id").alias("stop_id_curr"),
        (F.col("v.at") - F.lag("v.at").over(w)).alias("m"))
    return pairs.filter(F.col("stop_id_prev").isNotNull() & (F.col("m") >= 0)).groupBy(
        "stop_id_prev", "stop_id_curr").agg(F.median("m").alias("actual_path_length_meters"))


def signals_near_links(links: DataFrame, signals: DataFrame, in_degrees: bool = False, buffer: float | None = None) -> DataFrame:
    """Number of signals within a buffer of each link segment; a point-like link counts its box.

    Both sides meet on grid cells: a link enters every cell its buffered box touches, a signal
    only its own, so each pair is tested once.
    """
    ky = 1.0 if in_degrees else geo.BUFFER_M_PER_DEG_LAT
    lat0 = F.radians(F.lit(BUFFER_LAT_0))
    kx = F.lit(1.0) if in_degrees else F.lit(ky) * F.cos(lat0)
    reach = F.lit(buffer if buffer is not None else (BUFFER_DEG if in_degrees else BUFFER_M))
    cell = F.lit(0.005 if in_degrees else CELL_M)
    seg = links.select(
        "stop_id_prev", "stop_id_curr",
        (F.col("stop_lon_1") * kx).alias("x1"), (F.col("stop_lat_1") * F.lit(ky)).alias("y1"),
        (F.col("stop_lon_2") * kx).alias("x2"), (F.col("stop_lat_2") * F.lit(ky)).alias("y2"))
    box = {f"lo_{a}": F.least(f"{a}1", f"{a}2") - reach for a in "xy"}
    box.update({f"hi_{a}": F.greatest(f"{a}1", f"{a}2") + reach for a in "xy"})
    seg = seg.withColumns(box)
    for a in "xy":
        seg = seg.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"lo_{a}") / cell), F.floor(F.col(f"hi_{a}") / cell))))
    pts = signals.select((F.col("lon") * kx).alias("px"), (F.col("lat") * F.lit(ky)).alias("py"))
    pts = pts.withColumns({f"c{a}": F.floor(F.col(f"p{a}") / cell) for a in "xy"})
    px, py = F.col("px"), F.col("py")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    t = geo.position_on_segment(px, py, x1, y1, x2, y2, 0.0)
    off = F.pow(px - (x1 + t * (x2 - x1)), 2) + F.pow(py - (y1 + t * (y2 - y1)), 2)
    point_like = (x1 == x2) & (y1 == y2)
    in_box = px.between(F.col("lo_x"), F.col("hi_x")) & py.between(F.col("lo_y"), F.col("hi_y"))
    hits = seg.join(pts, ["cx", "cy"]).filter(in_box & (point_like | (off <= reach * reach)))
    counts = hits.groupBy("stop_id_prev", "stop_id_curr").agg(F.count(F.lit(1)).alias("signalized_intersection_count"))
    out = links.join(counts, ["stop_id_prev", "stop_id_curr"], "left")
    return out.withColumn("signalized_intersection_count", F.coalesce("signalized_intersection_count", F.lit(0)))


def corridor_class(street1: Column, street2: Column, is_tram: Column, length: Column) -> dict[str, Column]:
    """Corridor name, right of way and lanes by the first rule that matches."""
    first, second = F.lower(street1), F.lower(street2)
    name, row, lanes = F.lit(None).cast("string"), is_tram, F.when(length < 1500, 2).otherwise(3)
    for corridor, both, first_only, own_lane, n in reversed(CORRIDOR_RULES):
        hit = F.lit(False)
        for word in both:
            hit = hit | first.contains(word) | second.contains(word)
        for word in first_only:
            hit = hit | first.contains(word)
        name = F.when(hit, corridor).otherwise(name)
        row = F.when(hit, is_tram if own_lane is None else F.lit(own_lane)).otherwise(row)
        lanes = F.when(hit, n).otherwise(lanes)
    return {"corridor_name": name, "is_dedicated_right_of_way": row | is_tram, "lane_capacity": lanes}


LINK_TABLE = ["edge_id", "corridor_name", "stop_id_prev", "stop_id_curr", "stop_name_prev", "stop_name_curr",
              "segment_length_meters", "actual_path_length_meters", "tortuosity_ratio", "is_dedicated_right_of_way",
              "signalized_intersection_count", "lane_capacity"]


def with_path(links: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Path length never below the straight line, and tortuosity."""
    if paths is None:
        links = links.withColumn("actual_path_length_meters", F.lit(None).cast("double"))
    else:
        links = links.join(paths, ["stop_id_prev", "stop_id_curr"], "left")
    straight, path = F.col("segment_length_meters"), F.col("actual_path_length_meters")
    path = F.when(path.isNull() | (path < straight), straight).otherwise(round_half_even(path, 1))
    return links.withColumn("actual_path_length_meters", path).withColumn(
        "tortuosity_ratio", round_half_even(F.col("actual_path_length_meters") / F.greatest(straight, F.lit(1.0)), 3))


def citywide_links(
    stop_times: DataFrame, stops: DataFrame, signals: DataFrame, trips: DataFrame | None = None,
    paths: DataFrame | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """Link table of the whole network; ``known`` carries slugs of an earlier table over."""
    street = F.coalesce("street", F.lit("")) if "street" in stops.columns else F.coalesce("stop_name", F.lit(""))
    ends = with_end_points(scheduled_links(stop_times, trips), stops.withColumn("street", street),
                           ["stop_name", "stop_lat", "stop_lon", "street"])
    measured = with_path(ends.withColumn("segment_length_meters", round_half_even(link_length(), 1)), paths)
    counted = signals_near_links(measured, signals)
    tram = F.col("is_tram_link") == 1
    table = counted.withColumns(
        {
            **corridor_class(F.col("street_1"), F.col("street_2"), tram, F.col("segment_length_meters")),
            "edge_id": F.concat_ws("_", "stop_id_prev", "stop_id_curr"),
            "stop_name_prev": F.col("stop_name_1"), "stop_name_curr": F.col("stop_name_2"),
        }
    ).select(*LINK_TABLE)
    if known is not None and {"slug_prev", "slug_curr"} <= set(known.columns):
        slugs = known.groupBy("edge_id").agg(F.min_by(F.struct("slug_prev", "slug_curr"), F.struct("slug_prev", "slug_curr")).alias("s"))
        table = table.join(slugs, "edge_id", "left").select(*LINK_TABLE, "s.slug_prev", "s.slug_curr")
    return table


def corridor_stops(stops: DataFrame, zone_id: int | None = 1) -> DataFrame:
    """Stops on study corridors; a stop may belong to several."""
    rows = stops
    if zone_id is not None and "zone_id" in stops.columns:
        rows = rows.filter(F.col("zone_id").cast("int") == zone_id)
    hits = [F.when(F.col("street").rlike(f"(?i)(?u){p}"), F.lit(c)) for c, p, _, _ in STUDY_CORRIDORS]
    return rows.withColumn("corridor_name", F.explode(F.array_compact(F.array(*hits))))


def corridor_pairs(stop_times: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct consecutive stop pairs with both ends among the target stops."""
    ids = targets.select("stop_id").distinct()
    after = F.lead("stop_id").over(Window.partitionBy("trip_id").orderBy(F.col("stop_sequence").cast("int")))
    pairs = stop_times.select(F.col("stop_id").alias("stop_id_prev"), after.alias("stop_id_curr")).filter("stop_id_curr is not null").distinct()
    for key in ("stop_id_prev", "stop_id_curr"):
        pairs = pairs.join(ids.withColumnRenamed("stop_id", key), key, "left_semi")
    return pairs


def corridor_links(stop_times: DataFrame, stops: DataFrame, signals: DataFrame, zone_id: int | None = 1) -> DataFrame:
    """Link table of the study corridors; a stop on several corridors counts for its last one."""
    on = corridor_stops(stops, zone_id)
    rank = F.when(F.lit(False), 0)
    for i, (c, *_rest) in enumerate(STUDY_CORRIDORS):
        rank = rank.when(F.col("corridor_name") == c, i)
    named = on.withColumn("rank", rank).groupBy("stop_id").agg(
        F.first("stop_name").alias("stop_name"), F.first("stop_lat").alias("stop_lat"),
        F.first("stop_lon").alias("stop_lon"), F.max_by("corridor_name", "rank").alias("corridor_name"))
    ends = with_end_points(corridor_pairs(stop_times, on), named, ["stop_name", "stop_lat", "stop_lon", "corridor_name"])
    counted = signals_near_links(ends, signals, in_degrees=True)
    own, lanes = F.when(F.lit(False), True), F.when(F.lit(False), 0)
    for c, _, row, n in STUDY_CORRIDORS:
        own, lanes = own.when(F.col("corridor_name_1") == c, row), lanes.when(F.col("corridor_name_1") == c, n)
    length = round_half_even(link_length(), 1)
    return counted.select(
        F.concat_ws("_", "stop_id_prev", "stop_id_curr").alias("edge_id"), F.col("corridor_name_1").alias("corridor_name"),
        "stop_id_prev", "stop_id_curr", F.col("stop_name_1").alias("stop_name_prev"), F.col("stop_name_2").alias("stop_name_curr"),
        length.alias("segment_length_meters"), length.alias("actual_path_length_meters"), F.lit(1.0).alias("tortuosity_ratio"),
        own.alias("is_dedicated_right_of_way"), "signalized_intersection_count", lanes.alias("lane_capacity"))


def metro_distance(lat: Column, lon: Column) -> Column:
    """Distance to the nearest of the 38 stations, as one expression without a join."""
    pairs = ",".join(f"named_struct('lat', {a}D, 'lon', {b}D)" for a, b in METRO_STATIONS)
    return F.array_min(F.transform(F.expr(f"array({pairs})"), lambda s: geo.great_circle(lat, lon, s["lat"], s["lon"])))


def stop_hubs(stops: DataFrame, stop_times: DataFrame | None = None, trips: DataFrame | None = None) -> DataFrame:
    """Routes per stop, metro distance and the transfer-hub flag."""
    lines = F.lit(1).cast("long")
    rows = stops
    if stop_times is not None and trips is not None:
        served = stop_times.select("trip_id", "stop_id").distinct().join(trips.select("trip_id", "route_id"), "trip_id")
        counts = served.groupBy("stop_id").agg(F.countDistinct("route_id").alias("n_lines"))
        rows = rows.join(counts, "stop_id", "left")
        lines = F.coalesce("n_lines", lines)
    metres = metro_distance(F.col("stop_lat").cast("double"), F.col("stop_lon").cast("double"))
    rows = rows.withColumns({"interchange_line_count": lines, "__m": metres})
    near = transit.flag(F.col("__m") <= METRO_RADIUS_M)
    return rows.select(
        "stop_id", "stop_name", "interchange_line_count", near.alias("is_metro_proximity"),
        round_half_even(F.col("__m"), 1).alias("min_dist_to_metro_m"),
        transit.flag((F.col("interchange_line_count") >= HUB_LINES) | (near == 1)).alias("is_major_transfer_hub"))


def canonical_stops(ztm: DataFrame, zbk: DataFrame) -> DataFrame:
    """Match two stop registers: by position and post code, then the rest by name and post code."""
    a = ztm.filter(F.col("stop_id").try_cast("bigint").isNotNull()).select(
        F.col("stop_id").alias("ztm_id"), F.col("stop_name").alias("ztm_name"),
        F.lpad(F.substring("stop_id", -2, 2), 2, "0").alias("post_code"),
        F.col("stop_lat").cast("double").alias("lat_a"), F.col("stop_lon").cast("double").alias("lon_a"))
    b = zbk.select(
        F.col("stop_id").alias("zbk_slug"), F.col("stop_name").alias("canonical_name"),
        F.lpad(F.col("stop_code").cast("string"), 2, "0").alias("post_code"),
        F.col("stop_lat").cast("double").alias("stop_lat"), F.col("stop_lon").cast("double").alias("stop_lon"))
    out = ["ztm_id", "zbk_slug", "ztm_name", "canonical_name", "post_code", "stop_lat", "stop_lon"]
    a5 = a.withColumns({"lat5": round_half_even(F.col("lat_a"), 5), "lon5": round_half_even(F.col("lon_a"), 5)})
    b5 = b.withColumns({"lat5": round_half_even(F.col("stop_lat"), 5), "lon5": round_half_even(F.col("stop_lon"), 5)})
    placed = a5.join(b5, ["lat5", "lon5", "post_code"]).select(*out, F.lit("coord_and_post").alias("match_method"))
    rest_a = a.join(placed.select("ztm_id").distinct(), "ztm_id", "left_anti").withColumn("n_name", transit.normalize_name(F.col("ztm_name")))
    rest_b = b.join(placed.select("zbk_slug").distinct(), "zbk_slug", "left_anti").withColumn("n_name", transit.normalize_name(F.col("canonical_name")))
    named = rest_a.join(rest_b, ["n_name", "post_code"]).select(*out, F.lit("name_and_post").alias("match_method"))
    return placed.unionByName(named)


def _one_slug(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("ztm_id").agg(F.max("zbk_slug").alias("slug"))


def links_with_slugs(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Translate both link ends; an unmapped stop leaves its slug null."""
    one = _one_slug(mapping)
    for side in ("prev", "curr"):
        key = one.select(F.col("ztm_id").alias(f"stop_id_{side}"), F.col("slug").alias(f"__slug_{side}"))
        links = links.join(key, f"stop_id_{side}", "left").withColumn(f"slug_{side}", F.col(f"__slug_{side}")).drop(f"__slug_{side}")
    return links


def hubs_with_slugs(hubs: DataFrame, mapping: DataFrame) -> DataFrame:
    one = _one_slug(mapping).withColumnRenamed("ztm_id", "stop_id")
    return hubs.drop("zbk_slug").join(one, "stop_id", "left").withColumnRenamed("slug", "zbk_slug")


def match_rate(rows: DataFrame, slugs: list[str]) -> DataFrame:
    hit = F.lit(True)
    for c in slugs:
        hit = hit & F.col(c).isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("mapped"),
                    (F.count_if(hit) * 100.0 / F.count(F.lit(1))).alias("mapped_pct"))


def shared_codes(left: DataFrame, right: DataFrame, code: str) -> DataFrame:
    """Distinct codes on each side and in common."""
    a = left.select(code).filter(F.col(code).isNotNull()).distinct().withColumn("__l", F.lit(1))
    b = right.select(code).filter(F.col(code).isNotNull()).distinct().withColumn("__r", F.lit(1))
    return a.join(b, code, "full").agg(
        F.count("__l").alias("left_codes"), F.count("__r").alias("right_codes"),
        F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("common_codes"))


def along_shape(fixes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Linear reference of fixes on their shape: distance along it, offset from it, segment number.

    Segments of a shape travel as one array, so every fix gives exactly one row; the first of
    equally near segments wins. ``min_along`` and ``max_along`` columns, when present, limit the search.
    """
    along = Window.partitionBy("shape_id").orderBy("shape_pt_sequence")
    pts = shapes.withColumns({"x1": geo.planar_x(F.col("lon")), "y1": geo.planar_y(F.col("lat")), "seg": F.row_number().over(along) - 1})
    pts = pts.withColumns({"x2": F.lead("x1").over(along), "y2": F.lead("y1").over(along)}).filter("x2 is not null")
    pts = pts.withColumn("len", geo.euclid(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    pts = pts.withColumn("s0", F.sum("len").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
    lines = pts.groupBy("shape_id").agg(F.collect_list(F.struct("seg", "x1", "y1", "x2", "y2", "len", "s0")).alias("segs"))
    placed = fixes.withColumns({"__x": geo.planar_x(F.col("lon")), "__y": geo.planar_y(F.col("lat"))}).join(lines, "shape_id", "left")
    segs = F.col("segs")
    if "max_along" in fixes.columns:
        segs = F.filter(segs, lambda g: F.col("max_along").isNull() | (g["s0"] <= F.col("max_along")))
    if "min_along" in fixes.columns:
        segs = F.filter(segs, lambda g: g["s0"] + g["len"] >= F.coalesce("min_along", F.lit(0.0)))

    def project(g: Column) -> Column:
        x, y = F.col("__x"), F.col("__y")
        t = geo.position_on_segment(x, y, g["x1"], g["y1"], g["x2"], g["y2"], 1e-6)
        dx, dy = x - (g["x1"] + t * (g["x2"] - g["x1"])), y - (g["y1"] + t * (g["y2"] - g["y1"]))
        return F.struct((dx * dx + dy * dy).alias("d2"), g["seg"].alias("seg"), (g["s0"] + t * g["len"]).alias("along"))

    best = F.array_min(F.transform(segs, project))
    zero = F.lit(0.0)
    return placed.withColumn("__b", best).select(
        *fixes.columns, F.coalesce("__b.along", zero).alias("along_m"), F.coalesce(F.sqrt("__b.d2"), zero).alias("cross_m"),
        F.coalesce("__b.seg", F.lit(0)).alias("segment"))


def snapshot_for_day(snapshots: DataFrame, services: DataFrame, day: str) -> DataFrame:
    """Schedule snapshot for a day: newest with ten or more services, else most services, else newest.

    ``snapshots``: snapshot_id, feed_start, fetched_at. ``services``: snapshot_id, date (yyyymmdd), one row each.
    """
    on_day = services.filter(F.col("date") == day.replace("-", "")).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    scored = snapshots.join(on_day, "snapshot_id", "left").withColumn("n_services", F.coalesce("n", F.lit(0)))
    n = F.col("n_services")
    tier = F.when(n >= 10, 2).when(n > 0, 1).otherwise(0)
    order = F.struct(tier, F.when(tier == 1, n).otherwise(0), F.col("feed_start"), F.col("fetched_at"), F.col("snapshot_id"))
    return scored.agg(F.max_by(F.struct("snapshot_id", "n_services", "feed_start"), order).alias("s")).select("s.*")


def snapshots_by_day(snapshots: DataFrame, services: DataFrame, days: DataFrame) -> DataFrame:
    """(service_date, snapshot_id, n_services) by the rule of ``snapshot_for_day``, for all days (service_date, yyyy-mm-dd) at once.

    Days meet only snapshots that have services on them; the newest snapshot serves the others.
    """
    newest = snapshots.agg(F.max_by("snapshot_id", F.struct("feed_start", "fetched_at", "snapshot_id"))).first()[0]
    wanted = days.select("service_date").distinct().withColumn("date", F.replace("service_date", F.lit("-"), F.lit("")))
    counts = services.join(wanted, "date").groupBy("service_date", "snapshot_id").agg(F.count(F.lit(1)).alias("n_services"))
    n = F.col("n_services")
    order = F.struct((n >= 10).alias("many"), F.when(n < 10, n).otherwise(0).alias("few"), "feed_start", "fetched_at", "snapshot_id")
    best = counts.join(snapshots, "snapshot_id").groupBy("service_date").agg(F.max_by(F.struct("snapshot_id", "n_services"), order).alias("s"))
    return wanted.select("service_date").join(best, "service_date", "left").select(
        "service_date", F.coalesce("s.snapshot_id", F.lit(newest)).alias("snapshot_id"), F.coalesce("s.n_services", F.lit(0)).alias("n_services"))


def new_snapshots(registry: DataFrame, arrived: DataFrame) -> DataFrame:
    """Arrived snapshots whose digest the registry does not hold, the earliest of each digest."""
    first = arrived.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in arrived.columns if c != "sha256"]), "fetched_at_utc").alias("r"))
    fresh = first.join(registry.select("sha256").distinct(), "sha256", "left_anti")
    return fresh.select(*[F.col(c) if c == "sha256" else F.col(f"r.{c}").alias(c) for c in arrived.columns])
