import math
import random

from pyspark.sql import functions as F

from fleetlens.functions import geo
from fleetlens.operators import kinematics, network, schedule
from fleetlens.plans import gold, silver

FIX = ("service_date string, vehicle_type string, vehicle_number string, route_id string, brigade string, lat double, lon double, "
       "gps_timestamp_utc long, gps_time_str string, tick_ts long")


def fix(lat, lon, gps, tick, text=None, day="2026-10-18", veh="9999", route="503", brigade="7"):
    return (day, "bus", veh, route, brigade, lat, lon, gps, text or str(gps), tick)


def test_three_pings(spark):
    rows = [fix(52.23, 21.0, 100, 100), fix(52.23, 21.0, 100, 110), fix(52.23, 21.002, 120, 120)]
    got = silver.trajectories(spark.createDataFrame(rows, FIX)).orderBy("gps_timestamp_utc").collect()
    assert len(got) == 2 and got[0].n_ticks_seen == 2 and got[0].speed_mps == 0
    assert got[1].delta_t_s == 20 and got[1].delta_d_m > 100 and 5 < got[1].speed_mps < 10 and not got[1].is_static


def brute_clean(rows):
    out, prev, kept = [], {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[7], r[9], r[8], r[5], r[6])):
        veh = r[:3]
        if prev.get(veh) == (r[8], r[5], r[6]):
            out[kept[veh]][1] += 1
        else:
            before = out[kept[veh]][0] if veh in kept else None
            kept[veh] = len(out)
            out.append([r, 1, before[7] if before else None])
        prev[veh] = (r[8], r[5], r[6])
    return sorted(((o[0][2], o[0][7], o[0][9], o[1], o[2]) for o in out), key=str)


def test_collapse_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(800):
        gps = rng.randint(0, 12) * 1800
        rows.append(fix(52.2 + rng.randint(0, 1) * 0.001, 21.0, gps, gps + rng.randint(0, 9) * 10, "same" if rng.random() < 0.7 else str(gps), veh=rng.choice(["", "", "1"])))
    rows = list(set(rows))
    got = kinematics.clean_fixes(spark.createDataFrame(rows, FIX)).select("vehicle_number", "gps_timestamp_utc", "tick_ts", "n_ticks_seen", "prev_ts").collect()
    assert sorted(map(tuple, got), key=str) == brute_clean(rows)


def test_weekday_and_weekend_trips(spark):
    trips = spark.createDataFrame([("WD", "503", "7", "20261019"), ("WE", "503", "7", "20261018")], "trip_id string, route_id string, brigade string, service_id string")
    times = spark.createDataFrame([("WD", "12:24:00", "12:24:00"), ("WD", "13:10:00", "13:10:00"), ("WE", "12:27:00", "12:27:00"), ("WE", "13:12:00", "13:12:00")],
                                  "trip_id string, arrival_time string, departure_time string")
    dates = spark.createDataFrame([("20261019", "20261019", "1"), ("20261018", "20261018", "1")], "service_id string, date string, exception_type string")
    rows = [fix(52.2, 21.0, 1, 1, "2026-10-19 12:24:24", "2026-10-19"), fix(52.2, 21.0, 2, 2, "2026-10-18 12:27:10", "2026-10-18"), fix(52.2, 21.0, 3, 3, "2026-10-20 12:20:00", "2026-10-20")]
    fixes = spark.createDataFrame(rows, FIX)
    active = schedule.active_services(fixes.select("service_date"), None, dates)
    got = schedule.match_trips(fixes, schedule.trip_spans(trips, times), active).orderBy("gps_timestamp_utc").collect()
    # The third day has no active service, so all trips count and the nearer start wins.
    assert [r.matched_trip_id for r in got] == ["WD", "WE", "WD"]


def test_night_fix_reads_as_hour_24(spark):
    trips = spark.createDataFrame([("N", "503", "7", "s")], "trip_id string, route_id string, brigade string, service_id string")
    times = spark.createDataFrame([("N", "23:50:00", "23:50:00"), ("N", "24:40:00", "24:40:00")], "trip_id string, arrival_time string, departure_time string")
    fixes = spark.createDataFrame([fix(52.2, 21.0, 1, 1, "2026-10-18 00:30:00"), fix(52.2, 21.0, 2, 2, "2026-10-18 06:30:00")], FIX)
    got = schedule.match_trips(fixes, schedule.trip_spans(trips, times)).orderBy("gps_timestamp_utc").collect()
    assert [r.matched_trip_id for r in got] == ["N", None]


def brute_events(fixes, stops, radius=25.0):
    """The fold written plainly: visited stops of one trip."""
    fixes = sorted(fixes, key=lambda f: (f[0], f[1], f[2], f[3]))
    out, ptr = [], 0
    for seq, sx, sy in stops:
        d = [math.hypot(f[4] - sx, f[5] - sy) for f in fixes]
        if min(d) > 60 or ptr >= len(d) or min(d[ptr:]) > 60:
            continue
        low = min(d[ptr:])
        if low <= radius:
            inside = [i for i in range(ptr, len(d)) if d[i] <= radius]
            last = inside[0]
            for i in inside[1:]:
                gap = fixes[i][0] - fixes[last][0]
                if gap <= 180 or (i == last + 1 and gap <= 1200):
                    last = i
                else:
                    break
            out.append((seq, "STOPPED", inside[0], last))
            ptr = last
        else:
            ptr += d[ptr:].index(low)
            out.append((seq, "PASSED", ptr, ptr))
    return [(seq, kind, fixes[a][0], fixes[b][0]) for seq, kind, a, b in out]


def as_silver(spark, rows):
    return spark.createDataFrame(rows, FIX).withColumn("matched_trip_id", F.lit("T"))


def stop_tables(spark, stops):
    times = spark.createDataFrame([("T", f"S{s}", s, "x", "x") for s, _, _ in stops], "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string")
    place = spark.createDataFrame([(f"S{s}", f"Stop {s}", y / geo.M_PER_DEG_LAT + geo.LAT_0, x / geo.M_PER_DEG_LON + geo.LON_0) for s, x, y in stops],
                                  "stop_id string, stop_name string, stop_lat double, stop_lon double")
    return times, place


def test_fold_against_brute_force(spark):
    rng = random.Random(2)
    for case in range(4):
        stops = [(k, rng.uniform(0, 300), rng.uniform(-20, 20)) for k in range(1, 8)]
        rows, pts, t, x = [], [], 1000, -50.0
        for _ in range(60):
            t += rng.choice([10, 20, 200, 1300])
            x += rng.choice([-10, 0, 0, 5, 15])
            y = rng.uniform(-30, 30)
            lat, lon = y / geo.M_PER_DEG_LAT + geo.LAT_0, x / geo.M_PER_DEG_LON + geo.LON_0
            rows.append(fix(lat, lon, t, t))
            pts.append((t, t, lat, lon, x, y))
        times, place = stop_tables(spark, stops)
        marked = gold.stop_events(as_silver(spark, rows), times, place, complete_only=False)
        got = [(r.stop_sequence, r.event_type) for r in marked.orderBy("stop_sequence").collect()]
        want = brute_events(pts, stops)
        assert got == [(s, k) for s, k, _, _ in want], case
        passed = {r.stop_sequence: r.actual_arrival_utc for r in marked.collect() if r.event_type == "PASSED"}
        assert passed == {s: a for s, k, a, _ in want if k == "PASSED"}
        for r in marked.collect():
            for s, k, a, b in want:
                if s == r.stop_sequence and k == "STOPPED":
                    assert r.actual_arrival_utc <= a and r.actual_departure_utc >= b


def test_one_stop_visit(spark):
    west, here, east = (21.0 + m / geo.M_PER_DEG_LON for m in (-35, -10, 35))
    rows = [fix(52.23, west, 100, 100), fix(52.23, here, 110, 110), fix(52.23, here, 125, 125), fix(52.23, east, 135, 135)]
    times = spark.createDataFrame([("T", "S", 1, "x", "x")], "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string")
    place = spark.createDataFrame([("S", "Stop", 52.23, 21.0)], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    (r,) = gold.stop_events(as_silver(spark, rows), times, place).collect()
    assert r.event_type == "STOPPED" and r.confidence == "HIGH" and 100 < r.actual_arrival_utc < 110
    assert 125 <= r.actual_departure_utc < 135 and r.dwell_seconds > 15


def test_one_trip_on_two_days_with_two_timetables(spark):
    """Trip ids recur: each day has its own timetable and its own forecast."""
    lon = lambda x: x / geo.M_PER_DEG_LON + geo.LON_0
    days = ["2026-10-18", "2026-10-19"]
    rows = [fix(geo.LAT_0, lon(k * 500.0), 100 + k * 100, 100 + k * 100) for k in range(2)]
    silver = as_silver(spark, rows).withColumn("service_date", F.explode(F.array(*map(F.lit, days))))
    times, place = stop_tables(spark, [(0, 0.0, 0.0), (1, 500.0, 0.0)])
    both = times.withColumn("snapshot_id", F.lit("A")).unionByName(times.withColumn("snapshot_id", F.lit("B")).withColumn("stop_sequence", F.col("stop_sequence") + 10))
    forecast = spark.createDataFrame([(days[0], "T", 1, "delay", 11), (days[1], "T", 11, "delay", 22), (days[1], "T", 1, "delay", 33)],
                                     "service_date string, trip_id string, stop_sequence int, forecast_kind string, forecast_val long")
    which = spark.createDataFrame(list(zip(days, "AB")), "service_date string, snapshot_id string")
    got = gold.stop_events(silver, both, place, forecast, complete_only=False, snapshots=which).collect()
    assert sorted((r.service_date, r.stop_sequence, r.zbk_forecast_delay_s) for r in got) == [
        (days[0], 0, None), (days[0], 1, 11), (days[1], 10, None), (days[1], 11, 22)]


def test_incomplete_trip_is_dropped(spark):
    stops = [(k, k * 500.0, 0.0) for k in range(3)]
    times, place = stop_tables(spark, stops)
    times = times.unionByName(times.withColumn("trip_id", F.lit("U")))
    lon = lambda x: x / geo.M_PER_DEG_LON + geo.LON_0
    full = as_silver(spark, [fix(geo.LAT_0, lon(k * 500.0), 100 + k * 100, 100 + k * 100) for k in range(3)])
    part = as_silver(spark, [fix(geo.LAT_0, lon(500.0), 200, 200, veh="1")]).withColumn("matched_trip_id", F.lit("U"))
    got = gold.stop_events(full.unionByName(part), times, place).collect()
    assert {r.trip_id for r in got} == {"T"} and len(got) == 3


def test_network_fixtures(spark):
    signals = spark.createDataFrame([("1", 52.235, 21.000), ("2", 52.238, 21.0001), ("3", 52.235, 21.050)], "osmid string, lat double, lon double")
    link = spark.createDataFrame([("a", "b", 52.230, 21.0, 52.240, 21.0)], "stop_id_prev string, stop_id_curr string, stop_lat_1 double, stop_lon_1 double, stop_lat_2 double, stop_lon_2 double")
    assert network.signals_near_links(link, signals, in_degrees=True).first().signalized_intersection_count == 2
    shapes = spark.createDataFrame([("SH1", 1, 52.230, 21.000), ("SH1", 2, 52.235, 21.005), ("SH1", 3, 52.230, 21.010)], "shape_id string, shape_pt_sequence int, lat double, lon double")
    trips = spark.createDataFrame([("T", "SH1")], "trip_id string, shape_id string")
    times = spark.createDataFrame([("T", "S1", 1), ("T", "S2", 2)], "trip_id string, stop_id string, stop_sequence int")
    stops = spark.createDataFrame([("S1", "A", 52.230, 21.0), ("S2", "B", 52.230, 21.010)], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    paths = network.path_lengths(shapes, trips, times, stops)
    assert paths.first().actual_path_length_meters > 800
    (row,) = network.citywide_links(times, stops, signals, None, paths).collect()
    assert row.tortuosity_ratio > 1.1
    hubs = network.stop_hubs(
        spark.createDataFrame([("1001", "C", 52.2308, 21.0108), ("2001", "Far", 52.05, 20.85)], "stop_id string, stop_name string, stop_lat double, stop_lon double"),
        spark.createDataFrame([("a", "1001"), ("b", "1001"), ("a", "2001")], "trip_id string, stop_id string"),
        spark.createDataFrame([("a", "17"), ("b", "33")], "trip_id string, route_id string"))
    got = {r.stop_id: (r.interchange_line_count, r.is_metro_proximity) for r in hubs.collect()}
    assert got == {"1001": (2, 1), "2001": (1, 0)}


def test_trips_cut_by_batches_fold_alike(spark, monkeypatch):
    """Batches end anywhere; a trip's fixes are held until it is whole."""
    import pyarrow as pa

    from fleetlens.operators import stop_events

    rng = random.Random(8)
    lon = lambda x: x / geo.M_PER_DEG_LON + geo.LON_0
    rows = [(*fix(geo.LAT_0, lon(rng.uniform(-20, 1020)), t, t), f"T{k}") for k in range(30) for t in rng.sample(range(100, 9000), rng.randint(1, 25))]
    fixes = spark.createDataFrame(rows, FIX + ", trip_id string")
    times, place = stop_tables(spark, [(1, 0.0, 0.0), (2, 500.0, 0.0), (3, 1000.0, 0.0)])
    times = times.drop("trip_id").join(fixes.select("trip_id").filter("trip_id <> 'T7'").distinct())
    key = ["trip_id"]
    table = stop_events.trip_rows(stop_events.dominant_fixes(fixes, key), stop_events.planned_trips(times, place, key), key).toArrow()
    whole = pa.Table.from_batches(stop_events._fold_batches(iter(table.combine_chunks().to_batches()), 25.0)).sort_by([("trip_id", "ascending"), ("stop_sequence", "ascending")])
    assert whole.num_rows > 30 and "T7" not in whole.column("trip_id").to_pylist()
    monkeypatch.setattr(stop_events, "FOLD_ROWS", 40)
    cut = pa.Table.from_batches(stop_events._fold_batches(iter(table.combine_chunks().to_batches(max_chunksize=7)), 25.0))
    assert cut.sort_by([("trip_id", "ascending"), ("stop_sequence", "ascending")]).to_pylist() == whole.to_pylist()
