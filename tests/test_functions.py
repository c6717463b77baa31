import datetime
import math

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import clock, geo, transit
from fleetlens.functions.holidays import calendar_dimension, with_easter


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_local_text_and_repeated_hour(spark):
    rows = spark.createDataFrame(
        [("2026-10-18 14:00:00", 1792330000), ("2026-10-25 02:30:00", 1792888200 + 20), ("2026-10-25 02:30:00", 1792891800 + 20), ("broken", 5)],
        "text string, tick long")
    got = [r[0] for r in rows.select(clock.parse_local_text("text", "tick")).collect()]
    assert got == [1792324800, 1792888200, 1792891800, 5]


def test_timetable_past_midnight(spark):
    rows = spark.createDataFrame([("2026-10-19", "25:10:00"), ("2026-10-19", "01:10:00"), ("2026-10-20", "01:10:00"), ("2026-10-19", "x")], "d string, t string")
    a, b, c, bad = [r[0] for r in rows.select(clock.timetable_epoch("d", "t")).collect()]
    assert a == c == b + 86400 and bad == 0


def test_results_do_not_depend_on_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = one(spark, clock.epoch_to_local(F.lit(1792890000)).cast("string"), clock.hour_bucket(clock.epoch_to_local(F.lit(1792890000))).cast("string"))
        assert tuple(r) == ("2026-10-25 02:00:00", "2026-10-25 02:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_range_bounds(spark):
    rows = spark.createDataFrame([(1792274399,), (1792274400,), (1792360799,), (1792360800,)], "t long")
    kept = [r.t for r in rows.filter(transit.local_range(F.col("t"), "2026-10-18", "2026-10-18")).collect()]
    assert kept == [1792274400, 1792360799]
    with pytest.raises(ValueError):
        transit.local_range(F.col("t"), "2026-10-19", "2026-10-18")
    assert rows.filter(transit.local_range(F.col("t"))).count() == 4


def test_geometry(spark):
    x, y, back, flat, cross = one(
        spark, geo.planar_x(F.lit(21.02)), geo.planar_y(F.lit(52.24)), geo.planar_lon(geo.planar_x(F.lit(21.02))),
        geo.planar_distance(F.lit(52.23), F.lit(21.0), F.lit(52.24), F.lit(21.02)) / geo.great_circle(F.lit(52.23), F.lit(21.0), F.lit(52.24), F.lit(21.02)),
        geo.crossing_time(F.lit(100.0), F.lit(35.0), F.lit(110.0), F.lit(10.0)))
    assert abs(x - 683.2549) < 1e-6 and abs(y - 1112.7172) < 1e-6 and abs(back - 21.02) < 1e-12
    assert abs(flat - 1) < 0.003 and cross == pytest.approx(104.0)


def test_easter_and_calendar(spark):
    days = spark.createDataFrame([(datetime.date(y, 5, 1),) for y in (2024, 2025, 2026, 2027)], "day date")
    got = [str(r.easter) for r in with_easter(days).orderBy("day").collect()]
    assert got == ["2024-03-31", "2025-04-20", "2026-04-05", "2027-03-28"]
    cal = {r.calendar_date: r for r in calendar_dimension(spark, "2026-01-01", "2026-12-31").collect()}
    assert len(cal) == 365
    assert cal["2026-04-06"].is_public_holiday == 1 and cal["2026-06-04"].is_public_holiday == 1
    for free in ("2026-10-14", "2026-12-24", "2026-01-20", "2026-04-02"):
        assert cal[free].is_school_day == 0
    assert cal["2026-10-05"].is_school_day == 1
    assert cal["2026-12-31"].is_holiday_eve == 1 and cal["2026-04-30"].is_holiday_eve == 1 and cal["2026-01-03"].is_holiday_eve == 0


def test_cohorts(spark):
    rows = spark.createDataFrame([("190",), ("709",), ("L41",), ("n11",), ("17",), ("90",), ("x",)], "route string")
    got = [tuple(r) for r in rows.select(transit.cohort(F.col("route")), transit.is_tram(F.col("route"))).collect()]
    assert got == [("urban_bus", 0), ("suburban_bus", 0), ("suburban_bus", 0), ("night_bus", 0), ("urban_tram", 1), ("other", 1), ("other", 0)]


def test_names(spark):
    assert one(spark, transit.normalize_name(F.lit("Żółta Gęś, pl. 3-go"))).asDict().popitem()[1] == "zoltagespl3go"
    assert math.isclose(one(spark, geo.clamp01(F.lit(-3.0)))[0], 0.0)
