"""What is shuffled, and into how many parts."""

import re

from pyspark.sql import functions as F

from fleetlens import session
from fleetlens.operators import trajectory
from fleetlens.plans import catalog, domain, gold, mart
from fleetlens.streaming import feeds

SILVER = ("service_date string, vehicle_type string, vehicle_number string, route_id string, brigade string, lat double, lon double, gps_timestamp_utc long, "
          "tick_ts long, matched_trip_id string")


def test_fixes_are_shuffled_once(spark):
    """Position columns of fixes meet one exchange only; the first form had ten."""
    silver = spark.createDataFrame([], SILVER)
    times = spark.createDataFrame([], "trip_id string, stop_sequence int, stop_id string, arrival_time string, departure_time string")
    stops = spark.createDataFrame([], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation,org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation")
    try:
        events = gold.stop_events(silver.repartition(2), times.repartition(2), stops.repartition(2))
        tree = events._jdf.queryExecution().executedPlan().treeString()
    finally:
        spark.conf.unset("spark.sql.optimizer.excludedRules")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by_trip = re.findall(r"Exchange hashpartitioning\(service_date#\d+, [a-z_]*trip_id#\d+[^)]*\)", tree)
    assert 1 <= len(by_trip) <= 3, tree  # fixes, the trips seen, planned stops


def test_headway_shuffle_moves_source_columns_only(spark):
    """The first form shuffled calendar, progress and delay columns as well, 28 % more at 6 times sf0.1."""
    events = spark.createDataFrame([], (
        "service_date string, trip_id string, route_id string, vehicle_number string, vehicle_type string, stop_sequence int, stop_id string, stop_name string, "
        "scheduled_arrival_utc long, scheduled_departure_utc long, actual_arrival_utc long, actual_departure_utc long, arrival_delay_seconds int, "
        "departure_delay_seconds int, dwell_seconds int, zbk_forecast_delay_s int, forecast_error_s int, event_type string, confidence string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation,org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation")
    try:
        tree = mart.observed_mart(events.repartition(2))._jdf.queryExecution().executedPlan().treeString()
    finally:
        spark.conf.unset("spark.sql.optimizer.excludedRules")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = tree.splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(service_date#\d+, route_id#\d+, prev_stop_id#\d+,", line)]
    assert len(below) == 1 and "Project [" in below[0], tree
    assert not re.search("hour_of_day|trip_progress|delta_t_run|transit_cohort|trip_instance_key", below[0]), below[0]


def test_shuffle_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    number, advised = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advised)
    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    try:
        session.proportioned(rows)
        assert spark.conf.get(number, None) is None  # under 1 MB
        monkeypatch.setattr(session, "PARTITION_INPUT", 10_000)
        session.proportioned(rows)
        assert int(spark.conf.get(number)) == session.file_bytes(rows) // 10_000
        assert spark.conf.get(advised) == session.PARTITION_SHUFFLED
    finally:
        spark.conf.unset(number)
        spark.conf.set(advised, before)


def test_changes_shuffle_rows_once(spark):
    """Rows and state meet in one exchange; the first form cut them into hours and borders, and joined and merged the state apart."""
    update = "trip_id string, stop_sequence int, feed_timestamp long, rt_arrival_time long"
    batch = spark.createDataFrame([("T", 1, 20, 5), ("T", 1, 30, 6), ("U", 1, 30, 6), (None, 1, 30, 7), (None, 1, 40, 7)], update).repartition(2)
    before = spark.createDataFrame([("T", 1, 5, 10), ("V", 1, 9, 10)], "trip_id string, stop_sequence int, last_value long, last_time long").repartition(2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out, state = feeds.changes(batch, before, ttl_s=100)
        for df in (out, state):
            tree = df._jdf.queryExecution().executedPlan().treeString()
            assert len(re.findall("Exchange hashpartitioning", tree)) == 1, tree
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r.trip_id or "", r.feed_timestamp) for r in out.collect()) == [("", 30), ("T", 30), ("U", 30)]
    assert sorted((r.trip_id or "", r.last_value, r.last_time) for r in state.collect()) == [("", 7, 40), ("T", 6, 30), ("U", 6, 30), ("V", 9, 10)]


SF = "/root/testdata/sf0.001"


def plan_of(spark, build):
    """Physical plan without adaptive execution and broadcasts, in which every join and group that needs a shuffle shows it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return build()._jdf.queryExecution().executedPlan().treeString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_links_need_no_shuffle_beyond_lines_and_trips(spark):
    """The first form stored the stop events and shuffled them again for the windows along a trip."""
    tree = plan_of(spark, lambda: mart.observed_links(domain.stop_events.view(spark, SF)))
    assert len(re.findall("Exchange", tree)) == 2 and len(re.findall(r"Exchange hashpartitioning\(trip_id#\d+, \d+\)", tree)) == 2, tree


def test_deduplicated_updates_stay_where_they_met_their_trip(spark):
    def build():
        return trajectory.with_update_lags(trajectory.last_ping_per_stop(trajectory.with_trip_instance(domain.stop_updates.view(spark, SF))))

    tree = plan_of(spark, build)
    assert len(re.findall("Exchange", tree)) == 2, tree


def test_inventory_computes_no_headways(spark, monkeypatch):
    """The first form stored both marts whole; the legacy one took its links twice."""
    monkeypatch.setattr(domain, "stored", None)
    tree = plan_of(spark, lambda: catalog.QUERIES["q6_track_inventory"](spark, SF))
    assert not re.search("headway|median.*prev_stop_id", tree)
    assert len(re.findall(r"Exchange hashpartitioning\(trip_id#\d+, \d+\)", tree)) <= 4, tree


def test_vehicle_codes_are_not_stored_first(spark, monkeypatch):
    """The first form wrote every fix, with position and clock text, to count vehicle numbers."""
    monkeypatch.setattr(domain, "stored", None)
    found = catalog.QUERIES["j24_shared_vehicles"](spark, SF).first()
    trips = spark.read.parquet(f"{SF}/orders.parquet").join(spark.read.parquet(f"{SF}/lineitem.parquet"), F.col("o_orderkey") == F.col("l_orderkey"))
    assert found.right_codes == trips.select(F.col("o_orderkey") % 250).distinct().count()
    assert found.left_codes == found.common_codes + 1  # X1


def test_dominant_vehicles_come_from_the_view(spark, monkeypatch):
    """The first form stored every fix with its clock text; on the view, filters repeated the line's arithmetic for each of its seven fixes."""
    monkeypatch.setattr(domain, "stored", None)
    tree = plan_of(spark, lambda: catalog.QUERIES["a6_dominant_vehicle"](spark, SF))
    assert len(re.findall("Exchange", tree)) == 2, tree
    above = tree[:tree.index("Generate explode")]
    assert "l_partkey" not in above and "l_suppkey" not in above, tree


def test_trip_lines_aggregate_no_rows(spark):
    """The first form kept whole rows in an aggregate on sorts and moved every column of the lines."""
    tree = plan_of(spark, lambda: domain.trip_lines(spark, SF).select("trip_id", "l_linenumber", "start_sec"))
    assert "SortAggregate" not in tree and "max_by" not in tree, tree


def test_match_takes_a_duty_s_times_not_its_trips(spark, tmp_path, monkeypatch):
    """Trips with the same start and end give one step function; the first form carried each of them through its windows, and fixes through a shuffle."""
    from fleetlens.operators import schedule

    kept = {}
    monkeypatch.setattr(schedule, "written", lambda df, name: kept.setdefault(name, session.written(df, name)))
    spans = spark.range(200).select(F.format_string("T%03d", "id").alias("trip_id"), F.lit("5").alias("route_id"), F.lit("1").alias("brigade"), F.lit("s").alias("service_id"),
                                    F.format_string("08:%02d:00", F.col("id") % 4 * 10).alias("trip_start"), (28800 + F.col("id") % 4 * 600).alias("start_sec"), (29700 + F.col("id") % 4 * 600).alias("end_sec"))
    fixes = spark.createDataFrame([(f"2026-10-19 {t}", "5", "1") for t in ("07:44:00", "07:50:00", "08:05:00", "08:16:00", "08:50:00", "09:35:00")], "gps_time_str string, route_id string, brigade string")
    got = schedule.match_trips(fixes, spans).collect()
    assert {r.gps_time_str[11:16]: r.matched_trip_id for r in got} == {"07:44": None, "07:50": "T000", "08:05": "T000", "08:16": "T001", "08:50": "T003", "09:35": None}
    assert kept["timetable-kinds"].count() == 4 and kept["timetable-pieces"].filter("__shift = 0").count() <= 8


def test_trips_are_not_shuffled_by_service(spark):
    """The first form joined trips and days by service: two keys for all trips."""
    from fleetlens.operators import schedule
    from fleetlens.plans import queries_silver

    tree = plan_of(spark, lambda: schedule.spans_by_day(queries_silver.spans(spark, SF), queries_silver.active(spark, SF)))
    assert "BroadcastHashJoin [service_id" in tree and not re.search(r"Exchange hashpartitioning\(service_id#\d+, \d+\)", tree), tree


def test_delay_records_store_no_updates_and_times_first(spark, monkeypatch):
    """The first form wrote all updates and stop times and shuffled them again."""
    monkeypatch.setattr(domain, "stored", None)
    assert catalog.QUERIES["s7_j13_delay_records"](spark, SF).columns[:2] == ["feed_timestamp", "trip_id"]


def test_stop_events_store_no_fixes_and_shuffle_none(spark, monkeypatch):
    """The first form wrote every fix, read it back and shuffled it by trip; fixes now stay where their lines met their trip."""
    kept, store = [], domain.stored
    monkeypatch.setattr(domain, "stored", lambda spark, key, build: kept.append(key) or store(spark, key, build))
    tree = plan_of(spark, lambda: catalog.QUERIES["c3_stop_event_fold"](spark, SF))
    assert {k.split("_/")[0] for k in kept} == {"stop_times"}, kept
    assert not re.search("Exchange", tree[tree.index("MapInArrow"):tree.index("Generate explode")].split("SortMergeJoin")[1]), tree


def test_trajectory_makes_its_rows_once(spark, monkeypatch):
    """The first form stored all updates, and made and shuffled the rows once more for the medians."""
    monkeypatch.setattr(domain, "stored", None)
    tree = plan_of(spark, lambda: catalog.QUERIES["c5_trajectory"](spark, SF))
    assert "Window" not in tree and "Exchange hash" not in tree and "BroadcastHashJoin" in tree, tree


def test_chain_stores_no_trajectories(spark, monkeypatch):
    """The first form wrote the matched fixes between the tiers, as the fold read them twice."""
    from fleetlens.plans import queries_chain

    monkeypatch.setattr(queries_chain, "written", None, raising=False)
    assert catalog.QUERIES["e1_fixes_to_stop_events"](spark, SF).columns[:2] == ["service_date", "trip_id"]
