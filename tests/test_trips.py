import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators import trajectory as tr
from fleetlens.operators.chunked import with_neighbours, with_running_total
from fleetlens.operators.positions import values_at
from fleetlens.plans import mart

UPDATES = ("feed_timestamp long, trip_id string, route_id string, vehicle_id string, stop_id string, start_date string, stop_sequence int, "
           "arrival_delay_seconds int, departure_delay_seconds int, rt_arrival_time long, rt_departure_time long")


def test_lags_and_deltas(spark):
    rows = [(1, "T1", "17", "V", "a", "d", 1, 30, 35, 1000, 1005), (1, "T1", "17", "V", "b", "d", 2, 50, 50, 1120, 1120),
            (1, "T1", "17", "V", "c", "d", 3, 99, 99, 1, 1), (2, "T1", "17", "V", "c", "d", 3, 40, 45, 1250, 1255)]
    got = tr.reconstruct(spark.createDataFrame(rows, UPDATES)).orderBy("stop_sequence").collect()
    assert [r.delta_t_run for r in got] == [0.0, 15.0, -10.0]
    assert got[1].observed_run_time_s == 115
    assert [r.trip_progress for r in got] == [0.0, 0.5, 1.0]
    assert [r.is_terminal_stop for r in got] == [False, False, True]


def test_headway_deviation(spark):
    rows = [(1, f"T{i}", "17", "V", "s", "d", 1, 0, 0, t, t) for i, t in enumerate((1000, 1600, 2500))]
    got = tr.reconstruct(spark.createDataFrame(rows, UPDATES)).orderBy("rt_arrival_time").collect()
    assert [r.headway_actual_s for r in got] == [None, 600, 900]
    assert [r.headway_deviation for r in got] == [None, -150.0, 150.0]


def test_chunked_neighbours_equal_plain_window(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, rng.randint(0, 30000)]), rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k string, t long, v double")
    order = [F.col("t").asc_nulls_last(), F.col("id")]
    plain = Window.partitionBy("k").orderBy(*order)
    for width in (1, 700, 10**9):
        chunk = F.coalesce(F.floor(F.col("t") / width), F.lit(2**62))
        near = with_neighbours(df, ["k"], order, chunk, {"p": F.col("v")}, {"n": F.col("v")})
        want = df.withColumns({"p": F.lag("v").over(plain), "n": F.lead("v").over(plain)})
        assert sorted(near.select("id", "p", "n").collect(), key=str) == sorted(want.select("id", "p", "n").collect(), key=str)
        total = with_running_total(df, ["k"], order, chunk, F.lit(1), "s")
        want = df.withColumn("s", F.row_number().over(plain))
        assert sorted(total.select("id", "s").collect(), key=str) == sorted(want.select("id", "s").collect(), key=str)


def test_positions(spark):
    rng = random.Random(5)
    data = [rng.choice([7, rng.randint(-10**9, 10**12)]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in data], "x long")
    wanted = [0, 1, 250, 498, 499]
    assert values_at(df, F.col("x"), wanted) == [sorted(data)[i] for i in wanted]


EVENTS = ("service_date string, trip_id string, route_id string, vehicle_number string, vehicle_type string, stop_sequence int, stop_id string, stop_name string, "
          "scheduled_arrival_utc long, scheduled_departure_utc long, actual_arrival_utc long, actual_departure_utc long, arrival_delay_seconds int, "
          "departure_delay_seconds int, dwell_seconds int, zbk_forecast_delay_s int, forecast_error_s int, event_type string, confidence string")


def test_observed_mart(spark):
    t0 = 1792324800
    rows = []
    for seq, (stop, arr, dep, dwell, fc) in enumerate((("1001", 10, 15, 25, 12), ("1002", 30, 30, 20, 40), ("1003", 40, 40, 20, 45)), 1):
        at = t0 + seq * 120
        rows.append(("2026-10-18", "T_OBS_1", "190", "9", "bus", seq, stop, stop, at, at + 5, at + arr, at + 5 + dep, arr, dep, dwell, fc, arr - fc, "STOPPED", "HIGH"))
    events = spark.createDataFrame(rows, EVENTS)
    got = mart.observed_mart(events, exclude_terminals=False).orderBy("stop_sequence").collect()
    assert len(got) == 2
    assert got[0].prev_stop_id == "1001" and got[0].prev_stop_delay == 10 and got[0].delta_t_run == 15.0 and got[0].transit_cohort == "urban_bus"
    assert sum(r.dwell_seconds for r in got) / 2 == 20.0
    assert got[0].temperature_c == 11.3 and got[0].segment_length_meters == 500.0 and got[0].is_school_day == 0
    assert mart.observed_mart(events).count() == 1


def test_two_stop_trip_survives_terminal_filter(spark):
    rows = [(1, "T", "190", "V", s, "d", i, 10, 10, 1792324800 + i, 1792324800 + i) for i, s in ((1, "a"), (2, "b"))]
    assert mart.legacy_mart(spark.createDataFrame(rows, UPDATES)).count() == 1


def test_either_key_join_repeats_only_distinct_links(spark):
    rows = [(1, "T", "190", "V", s, "d", i, 10, 10, 1792324800 + i, 1792324800 + i) for i, s in ((1, "a"), (2, "b"))]
    links = spark.createDataFrame([("e1", "a", "b", "a", "b"), ("e2", "a", "b", "x", "y"), ("e3", "p", "q", "a", "b"), ("e4", None, None, "a", "b")],
                                  "edge_id string, stop_id_prev string, stop_id_curr string, slug_prev string, slug_curr string")
    links = links.withColumns({"corridor_name": F.col("edge_id"), "segment_length_meters": F.lit(1.0), "signalized_intersection_count": F.lit(1),
                               "is_dedicated_right_of_way": F.lit(True), "lane_capacity": F.lit(1)})
    got = mart.legacy_mart(spark.createDataFrame(rows, UPDATES), mart.Dimensions(links=links))
    assert sorted(r.corridor_name for r in got.collect()) == ["e1", "e2", "e3", "e4"]
