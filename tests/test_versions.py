"""Versioned tables: a write that is lost half-way leaves the old table whole."""

import pytest
from pyspark.sql import functions as F

from fleetlens.sources import sinks, versions

KEYS = ["station", "hour"]
SCHEMA = "station string, hour int, temp double"


def temps(df):
    return {(r.station, r.hour): r.temp for r in df.collect()}


def test_lost_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.upsert(spark, path, spark.createDataFrame([("s", 1, 5.0), ("t", 1, 6.0)], SCHEMA), KEYS, [F.col("temp")])
    later = spark.createDataFrame([("s", 1, 1.0), ("u", 2, 2.0)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(versions.Folder, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError, match="driver lost"):
            sinks.upsert(spark, path, later, KEYS, [F.col("temp")])
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # the new files are there, no version names them
    assert temps(versions.read(spark, path)) == {("s", 1): 5.0, ("t", 1): 6.0}
    assert temps(sinks.upsert(spark, path, later, KEYS, [F.col("temp")])) == {("s", 1): 1.0, ("t", 1): 6.0, ("u", 2): 2.0}


def test_second_writer_of_a_version_fails(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("s", 1, 5.0)], SCHEMA)
    first = versions.commit(rows, path)
    versions.commit(rows.withColumn("temp", F.lit(7.0)), path, base=first)
    with pytest.raises(versions.Conflict):
        versions.commit(rows, path, base=first)
    with pytest.raises(versions.Conflict):
        versions.Folder(spark, path).publish(2, {"parts": {}})
    assert temps(versions.read(spark, path)) == {("s", 1): 7.0}


def test_old_versions_stay_readable_once_and_then_go(spark, tmp_path):
    path = str(tmp_path / "t")
    frames = []
    for v in (1.0, 2.0, 3.0):
        versions.commit(spark.createDataFrame([("s", 1, v)], SCHEMA), path)
        frames.append(versions.read(spark, path))
    assert temps(frames[1]) == {("s", 1): 2.0} and temps(frames[2]) == {("s", 1): 3.0}
    assert versions.Folder(spark, path).numbers() == [2, 3] and len(list((tmp_path / "t" / "data").iterdir())) <= 3


def test_hours_replace_only_their_dates(spark, tmp_path):
    path = str(tmp_path / "h")
    schema = "date string, hour_utc string, v int"
    rows = spark.createDataFrame([("2026-10-01", "08", 1), ("2026-10-01", "09", 2), ("2026-10-02", "08", 3)], schema)
    versions.materialize_hours(spark, path, rows, sinks.pending_hours(rows, None))
    before = versions.Folder(spark, path).newest()[1]["parts"]
    again = spark.createDataFrame([("2026-10-01", "09", 9), ("2026-10-01", "08", 7)], schema)
    versions.materialize_hours(spark, path, again, again.filter("hour_utc = '09'").select("date", "hour_utc"))
    after = versions.Folder(spark, path).newest()[1]["parts"]
    assert sorted((r.date, r.hour_utc, r.v) for r in versions.read(spark, path).collect()) == [("2026-10-01", "08", 1), ("2026-10-01", "09", 9), ("2026-10-02", "08", 3)]
    assert before["2026-10-02"] == after["2026-10-02"] and before["2026-10-01"] != after["2026-10-01"]
    assert versions.read(spark, path, ["2026-10-02"]).count() == 1 and versions.read(spark, str(tmp_path / "none")) is None
