import json
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.sources import sinks, tables, ticks, weather
from fleetlens.streaming import feeds

UPDATE = "trip_id string, stop_sequence int, feed_timestamp long, rt_arrival_time long"


def write_tick(base, hour, epoch, vehicles):
    folder = os.path.join(base, "source=um_bus", "date=2026-10-18", f"hour={hour}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"tick_{epoch}.json"), "w") as f:
        f.write(vehicles if isinstance(vehicles, str) else json.dumps(vehicles))


def vehicle(text, lat=52.2):
    return {"VehicleNumber": "77", "Lines": "190", "Brigade": "1", "Lat": lat, "Lon": 21.0, "Time": text}


def test_tick_files_and_incremental_hours(spark, tmp_path):
    base, out = str(tmp_path / "bronze"), str(tmp_path / "fixes")
    write_tick(base, "08", 1792310400, [vehicle("2026-10-18 10:00:00"), vehicle("2026-10-18 10:00:00", 0)])
    write_tick(base, "08", 1792310410, "garbage")

    def extract():
        return ticks.payload_fixes(ticks.tick_files(spark, base)).withColumnRenamed("service_date", "date")

    rows = extract()
    assert rows.count() == 1 and rows.first().gps_timestamp_utc == 1792310400 and rows.first().hour_utc == "08"
    sinks.materialize_hours(spark, out, rows, sinks.pending_hours(rows, None))
    write_tick(base, "09", 1792314000, {"result": [vehicle("2026-10-18 11:00:00")]} and [vehicle("2026-10-18 11:00:00")])
    for _ in range(2):
        rows = extract()
        sinks.materialize_hours(spark, out, rows, sinks.pending_hours(rows, spark.read.parquet(out).withColumn("date", F.col("date").cast("string"))))
    assert [r.hour_utc for r in spark.read.parquet(out).orderBy("hour_utc").collect()] == ["08", "09"]
    assert sinks.pending_hours(rows, None, "2026-10-18 09").count() == 1


def test_compaction_keeps_rows(spark, tmp_path):
    src, dst = str(tmp_path / "small"), str(tmp_path / "big")
    df = spark.range(100).select((F.col("id") % 3).alias("hour"), "id").repartition(10)
    df.write.partitionBy("hour").parquet(src)
    assert sinks.compact(spark, src, dst, F.col("hour") < 2) == 67
    assert spark.read.parquet(dst).count() == 67
    for hour in (0, 1):
        assert len(list((tmp_path / "big" / f"hour={hour}").glob("*.parquet"))) == 1
    assert not (tmp_path / "big.staging").exists()


def test_damaged_table_is_not_taken_for_a_missing_one(spark, tmp_path):
    assert sinks.read_if_exists(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    rows = spark.createDataFrame([("s", 1, 5.0)], "station string, hour int, temp double")
    with pytest.raises(Exception):  # noqa: B017  whichever error the reader gives
        sinks.upsert(spark, str(tmp_path / "bad"), rows, ["station", "hour"], [F.col("temp")])
    assert (tmp_path / "bad" / "part-0.parquet").read_text() == "no parquet"


def test_lost_state_stops_the_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def step(i):
        spark.createDataFrame([("T", 1, i, i)], UPDATE).coalesce(1).write.mode("append").parquet(src)
        feeds.run_step(spark.readStream.schema(UPDATE).parquet(src), feeds.changes, out, state, str(tmp_path / "cp"), None).start().awaitTermination()

    for i in range(3):
        step(i)
    assert sorted(x.name for x in (tmp_path / "state").iterdir()) == ["v=1", "v=2"]
    sinks.remove(spark, f"{state}/v=2")
    with pytest.raises(Exception, match="v=2"):
        step(3)


def test_latest_forecasts_give_changes_and_expire(spark):
    schema = "trip_id string, stop_sequence int, hour_utc string, tick_ts long, value int"
    _, state = feeds.latest_forecasts(spark.createDataFrame([("A", 1, "08", 10, 1), ("B", 1, "08", 10, 1)], schema), None)
    out, state = feeds.latest_forecasts(spark.createDataFrame([("B", 1, "09", 2000, 2)], schema), state, ttl_s=1000)
    assert [r.trip_id for r in out.collect()] == ["B"] and [(r.trip_id, r.value) for r in state.collect()] == [("B", 2)]
    out, state = feeds.latest_forecasts(spark.createDataFrame([], schema), state, ttl_s=1000)
    assert out.count() == 0 and state.count() == 1


def test_date_overwrite_append_and_upsert(spark, tmp_path):
    path = str(tmp_path / "days")
    df = spark.createDataFrame([("2026-10-01", 1), ("2026-10-02", 2)], "date string, v int")
    sinks.write_dates(df, path)
    sinks.write_dates(df.filter("v = 2").withColumn("v", F.lit(9)), path, ["v"])
    assert sorted(r.v for r in tables.scan_days(spark, path).collect()) == [1, 9]
    assert tables.scan_days(spark, path, "2026-10-02").count() == 1
    raw = str(tmp_path / "raw")
    sinks.append_days(df, raw, F.lit("2026-10-05 01:00:00").cast("timestamp_ntz"))
    assert tables.scan_raw(spark, raw, "raw_delays").select("year", "month", "day").first()[0] == 2026
    keyed = str(tmp_path / "weather")
    a = spark.createDataFrame([("s", 1, 5.0), ("t", 1, 6.0)], "station string, hour int, temp double")
    sinks.upsert(spark, keyed, a, ["station", "hour"], [F.col("temp")])
    got = sinks.upsert(spark, keyed, a.filter("station = 's'").withColumn("temp", F.lit(1.0)), ["station", "hour"], [F.col("temp")])
    assert {r.station: r.temp for r in got.collect()} == {"s": 1.0, "t": 6.0}


def test_timetable_text(spark, tmp_path):
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_sequence,arrival_time\nT,1,24:10:00\nT,x,25:00:00\n")
    rows = tables.timetable(spark, str(tmp_path), "stop_times").collect()
    assert [r.stop_sequence for r in rows] == [1, None] and rows[0].arrival_time == "24:10:00"


def test_weather_archive(spark, tmp_path):
    def line(name, n=45, rain="1.5", temp="-2.0"):
        f = ["0"] * n
        f[0:6] = ["352", f'"{name}"', "2026", "1", "5", "7"]
        if n > 41:
            f[27], f[32], f[24], f[38], f[17], f[40] = temp, "80", "3.5", "", "9000", rain
        return ",".join(f)

    path = tmp_path / "s.csv"
    path.write_bytes("\n".join([line("WARSZAWA-OKĘCIE"), line("ŁÓDŹ"), line("WARSZAWA", 20), line("WARSZAWA", rain="x", temp="bad")]).encode("iso-8859-2"))
    (r,) = weather.archive(spark, str(path), "warszawa").collect()
    assert r.station_name == "WARSZAWA-OKĘCIE" and r.temperature_c == -2.0 and r.precipitation_mm == 1.5 and r.freezing_rain_flag
    assert r.pressure_hpa is None and str(r.timestamp) == "2026-01-05 07:00:00"


def test_change_only_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    values = [("T", 1, 10, 100), ("T", 1, 20, 100), ("T", 1, 30, 200), ("T", 1, 40, 100), ("U", 1, 40, None), ("U", 1, 50, None)]
    for i in range(0, 6, 2):
        spark.createDataFrame(values[i:i + 2], UPDATE).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(UPDATE).parquet(src)
        feeds.run_step(stream, feeds.changes, out, str(tmp_path / "state"), str(tmp_path / "cp"), None).start().awaitTermination()
    got = sorted((r.trip_id, r.feed_timestamp) for r in spark.read.parquet(out).collect())
    assert got == [("T", 10), ("T", 30), ("T", 40), ("U", 40)]


def test_old_state_is_forgotten(spark):
    a = spark.createDataFrame([("T", 1, 10, 100)], UPDATE)
    b = spark.createDataFrame([("U", 1, 10**7, 100)], UPDATE)
    _, state = feeds.changes(a, None)
    _, state = feeds.changes(b, state, ttl_s=1000)
    assert [r.trip_id for r in state.collect()] == ["U"]


def test_streamed_movement_equals_batch(spark):
    from tests.test_observed import FIX, fix

    rows = [fix(52.2 + i * 0.001, 21.0, 1000 * i, 1000 * i) for i in range(8)]
    whole, _ = feeds.moving_fixes(spark.createDataFrame(rows, FIX), None)
    first, state = feeds.moving_fixes(spark.createDataFrame(rows[:5], FIX), None)
    second, _ = feeds.moving_fixes(spark.createDataFrame(rows[5:], FIX), state)
    cols = ["gps_timestamp_utc", "delta_t_s", "delta_d_m", "speed_mps"]
    assert sorted(first.unionByName(second).select(*cols).collect()) == sorted(whole.select(*cols).collect())


def test_sealed_hours_stream(spark, tmp_path):
    src = str(tmp_path / "fx")
    schema = "vehicle_type string, gps_timestamp_utc long, tick_ts long"
    t0 = 1792310400
    for t in (t0, t0 + 10, t0 + 3600 + 400, t0 + 7200):
        spark.createDataFrame([("bus", t, t), ("bus", t, t + 900)], schema).coalesce(1).write.mode("append").parquet(src)
    q = feeds.sealed_hours(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.format("memory").queryName("sealed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(int(r.hour_start.timestamp()), r.fixes) for r in spark.table("sealed").collect()]
    assert (t0, 2) in got and all(h < t0 + 7200 for h, _ in got)


def test_gaps_of_ticks(spark):
    """Off-grid ticks are no ticks of the grid; gaps longer than a chunk are spelt out whole, the one at the end too."""
    times = [0, 10, 30, 35, 40, 10 * 3 * feeds.CHUNK_TICKS, 10 * 3 * feeds.CHUNK_TICKS + 45]
    log = spark.createDataFrame([("a", t, "OK", 1) for t in times] + [("a", 10, "TIMEOUT", 2), ("b", 7, "OK", 1), ("c", 5, None, 1)], "source string, tick_ts long, status string, recorded int")
    got = sorted((r.source, r.tick_ts, r.status) for r in feeds.tick_completeness(log, 10).collect())
    seen = {("a", t): "OK" for t in times} | {("a", 10): "TIMEOUT", ("b", 7): "OK"}
    want = [("a", t, seen.get(("a", t), "MISSED_TICK")) for t in range(0, times[-1] + 1, 10)] + [("b", 7, "OK"), ("c", 5, "MISSED_TICK")]
    assert got == sorted(want)
