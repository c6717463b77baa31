"""Study windows over the days of sources, and the scoreboard of several models."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from fleetlens.models import metrics
from fleetlens.plans import reports


def on(n):
    return datetime.date(2026, 10, 1) + datetime.timedelta(days=n)


def test_study_window_of_sources_with_gaps(spark):
    held = {"updates": [0, 1, 2, 3, 4, 6, 7, 8, 9], "weather": [1, 2, 3, 4, 5, 6, 7], "fixes": [2, 2, 3, 4, 6, 7, 8, None]}
    frames = {s: (spark.createDataFrame([(on(d) if d is not None else None,) for d in days], "d date"), F.col("d")) for s, days in held.items()}
    got = {r.source: r for r in reports.study_window(reports.source_days(frames), "updates").collect()}
    assert got.keys() == held.keys()
    for r in got.values():
        assert (r.common_start, r.common_end, r.is_ready, r.recommended_start, r.recommended_end) == (on(2), on(7), True, on(2), on(4))
    assert (got["weather"].lag_days, got["fixes"].lag_days, got["updates"].lag_days) == (2, 1, 0)
    assert (got["updates"].n_spans, got["updates"].missing_days, got["fixes"].rows, got["fixes"].n_days) == (2, 1, 7, 6)


def test_sources_that_never_meet_recommend_nothing(spark):
    frames = {"updates": (spark.createDataFrame([(on(0),)], "d date"), F.col("d")), "weather": (spark.createDataFrame([(on(5),)], "d date"), F.col("d"))}
    for r in reports.study_window(reports.source_days(frames), "updates").collect():
        assert not r.is_ready and r.recommended_start is None and r.recommended_end is None and r.lag_days == 0


def test_scoreboard_against_plain_loop(spark):
    rng = random.Random(11)
    rows = [(rng.gauss(20, 40), rng.gauss(15, 30), 0.0, rng.choice(["a", "b", "other", None])) for _ in range(501)] + [(None, 1.0, 0.0, "a"), (1.0, float("nan"), 0.0, "b")]
    df = spark.createDataFrame(rows, "y double, p double, z double, transit_cohort string")
    got = {(r.model, r.cohort): r for r in metrics.scoreboard(df, "y", {"one": "p", "zero": "z"}, cohorts=["a", "b", "none"]).collect()}
    assert got.keys() == {(m, c) for m in ("one", "zero") for c in ("all", "a", "b")}
    for (m, c), r in got.items():
        own = [(y, p if m == "one" else z) for y, p, z, k in rows if y is not None and (m == "zero" or p == p) and c in ("all", k)]
        errors = [abs(p - y) for y, p in own]
        mean = statistics.fmean(y for y, _ in own)
        assert r.rows == len(own)
        assert r.mae == pytest.approx(statistics.fmean(errors), abs=1e-4) and r.rmse == pytest.approx(statistics.fmean(e * e for e in errors) ** 0.5, abs=1e-4)
        assert r.medae == pytest.approx(statistics.median(errors), abs=1.1e-3) and r.max_error == pytest.approx(max(errors), abs=1e-4)
        assert r.r2 == pytest.approx(1 - sum(e * e for e in errors) / sum((y - mean) ** 2 for y, _ in own), abs=1e-4)
        assert r.pearson_r == pytest.approx(statistics.correlation(*zip(*own)) if m == "one" else 0.0, abs=1e-4)


def test_rows_away_from_terminals(spark):
    df = spark.createDataFrame([(1, True, 0.2), (2, False, 1.0), (3, None, 0.5)], "id int, is_terminal_stop boolean, trip_progress double")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(metrics.without_terminals(df)) == [2] and ids(metrics.without_terminals(df.drop("is_terminal_stop"))) == [1, 3]
    assert ids(metrics.without_terminals(df.select("id"))) == [1, 2, 3]
