"""Registered chain through the tiers: fixes to clean, matched trajectories to observed stop events, on trips that run on several days."""

from __future__ import annotations

import re

from fleetlens.plans import domain, gold
from fleetlens.plans.queries_gold import EVENT_STEPS, GOLD_KINDS, forecasts
from fleetlens.plans.queries_silver import MATCH, trajectories
from fleetlens.plans.registry import comparable, comparable_sql, query
from fleetlens.plans.views_sql import with_views

#: Steps of both tiers that have one name get another in the first.
_RENAMED = {"usable": "open_trips", "timed": "read_fixes"}


def _matched() -> list[tuple[str, str]]:
    named = re.compile(rf"\b({'|'.join(_RENAMED)})\b")
    return [tuple(named.sub(lambda m: _RENAMED[m[0]], part) for part in step) for step in MATCH]


def _observed() -> list[tuple[str, str]]:
    """The steps of the stop events over the matched trajectories, a trip being planned on every day on which it was seen."""
    changes = {"usable": [("FROM vehicle_fixes", "FROM linked")],
               "planned": [("JOIN trips t ON", "JOIN dominant t ON"), ("PARTITION BY st.trip_id", "PARTITION BY t.service_date, st.trip_id")],
               "delays": [("p.stop_sequence = t.stop_sequence", "p.stop_sequence = t.stop_sequence AND p.service_date = t.service_date")]}
    out = []
    for name, sql in EVENT_STEPS:
        for old, new in changes.get(name, ()):
            assert old in sql, (name, old)
            sql = sql.replace(old, new)
        out.append((name, sql))
    return out


LINKED = ("linked", """SELECT service_date, vehicle_type, vehicle_number, route_id, brigade, lat, lon, gps_timestamp_utc, tick_ts, matched_trip_id AS trip_id
  FROM silver WHERE matched_trip_id IS NOT NULL""")


@query("e1_fixes_to_stop_events", with_views(["vehicle_fixes", "schedule_trips", "stop_times", "stops", "stop_updates"], comparable_sql(GOLD_KINDS, "gold", 2), [*_matched(), LINKED, *_observed()]))
def fixes_to_stop_events(spark, sf):
    return comparable(gold.stop_events(trajectories(spark, sf), domain.stop_times(spark, sf), domain.stops(spark, sf), forecasts(spark, sf)), 2)
