"""Keyed stream state against the same rows as one batch, over several files and restarts."""

import random

from pyspark.sql import functions as F

from fleetlens.operators import kinematics
from fleetlens.streaming import feeds, keyed
from tests.test_observed import FIX, fix

UPDATE = "trip_id string, stop_sequence int, feed_timestamp long, rt_arrival_time long"


def in_files(spark, rows, schema, path, parts):
    """The rows in order, cut into files; a stream reads one a batch."""
    step = -(-len(rows) // parts)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], schema).coalesce(1).write.mode("append").parquet(path)
        yield spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def streamed(spark, rows, schema, tmp, make, parts=3):
    """All output after a run, a stop and a restart per file."""
    for stream in in_files(spark, rows, schema, str(tmp / "in"), parts):
        out = keyed.to_table(make(stream), str(tmp / "out"), str(tmp / "cp"))
    return out


def test_changes_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted({(f"T{rng.randint(0, 4)}", rng.randint(1, 3), t, rng.choice([100, 200, None])) for t in range(1000, 1400, 2)}, key=lambda r: r[2])
    got = streamed(spark, rows, UPDATE, tmp_path, keyed.changes)
    want, _ = feeds.changes(spark.createDataFrame(rows, UPDATE), None)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)


def test_old_state_expires(spark, tmp_path):
    """A silent trip is forgotten, so its value counts as changed again; a trip that goes on is not."""
    rows = [("T", 1, 1000, 5), ("U", 1, 1000, 5), ("U", 1, 1900, 5), ("U", 1, 2800, 5), ("U", 1, 3700, 5), ("U", 1, 4600, 5), ("T", 1, 4600, 5)]
    got = streamed(spark, rows, UPDATE, tmp_path, lambda s: keyed.changes(s, ttl_s=1000), parts=7)
    assert sorted((r.trip_id, r.feed_timestamp) for r in got.collect()) == [("T", 1000), ("T", 4600), ("U", 1000)]


def test_latest_forecasts_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"T{rng.randint(0, 3)}", rng.randint(1, 3), f"{rng.randint(7, 9):02d}", 1000 + t, t) for t in range(90)]
    schema = "trip_id string, stop_sequence int, hour_utc string, tick_ts long, val int"
    got = streamed(spark, rows, schema, tmp_path, keyed.latest_forecasts)
    want, _ = feeds.latest_forecasts(spark.createDataFrame(rows, schema), None)
    newest, _ = feeds.latest_forecasts(got, None)
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, want.select(*newest.columns).collect()))


def test_movement_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        rows.append(fix(52.2 + rng.randint(0, 2) * 0.001, 21.0, 1000 + i // 2 * 10, 1000 + i * 5, str(1000 + i // 2 * 10) if rng.random() < 0.5 else "same", veh=rng.choice(["1", "2"])))
    rows.sort(key=lambda r: (r[7], r[9]))
    got = streamed(spark, rows, FIX, tmp_path, keyed.moving_fixes)
    want = kinematics.with_movement(kinematics.clean_fixes(spark.createDataFrame(rows, FIX)))
    columns = ["vehicle_number", "gps_timestamp_utc", "tick_ts", "delta_t_s", "delta_d_m", "speed_mps", "is_static"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


class _Store:
    """A state store for one key that counts its writes."""

    def __init__(self):
        self.value, self.writes, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_bucket_of_trips_is_one_call(tmp_path):
    """A thousand trips cost one write a batch, and their stops stay apart."""
    import pandas as pd

    columns = ["trip_id", "stop_sequence", "feed_timestamp", "rt_arrival_time"]
    store, processor = _Store(), keyed.ChangedValues(columns, "rt_arrival_time", "feed_timestamp", ["feed_timestamp", "rt_arrival_time"], 1000)
    processor.init(store)
    kept = []
    for at, value in ((100, 5), (200, 5), (300, 6)):
        batch = pd.DataFrame([(f"T{i}", 1, at, value + i) for i in range(1000)], columns=columns)
        kept.append(sum(len(out) for out in processor.handleInputRows((0,), iter([batch]), None)))
    assert (kept, store.writes) == ([1000, 0, 1000], 3)
    assert store.timers[-1] == 1300 * 1000
