"""The two feature marts: one row per stop-to-stop link with delays, headways and context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import clock, transit
from fleetlens.functions.rounding import round_half_up
from fleetlens.operators import dimensions as dim
from fleetlens.operators import trajectory as tr


@dataclass(frozen=True)
class Dimensions:
    """Context tables; a missing one is replaced by a typed empty table."""

    weather: DataFrame | None = None
    links: DataFrame | None = None
    calendar: DataFrame | None = None
    hubs: DataFrame | None = None

    def filled(self, like: DataFrame) -> "Dimensions":
        spark = like.sparkSession

        def pick(df: DataFrame | None, schema: str) -> DataFrame:
            return df if df is not None else dim.empty(spark, schema)

        return Dimensions(
            pick(self.weather, dim.WEATHER), pick(self.links, dim.LINKS),
            pick(self.calendar, dim.CALENDAR), pick(self.hubs, dim.HUBS),
        )


LINK_COLUMNS = [
    "corridor_name", "segment_length_meters", "actual_path_length_meters", "tortuosity_ratio",
    "signalized_intersection_count", "is_dedicated_right_of_way", "lane_capacity",
]
HUB_COLUMNS = ["interchange_line_count", "is_metro_proximity"]


def inner_stops(exclude_terminals: bool) -> Column:
    keep = ~F.col("is_terminal_stop") | (F.col("max_seq") <= F.col("min_seq") + 1)
    return keep if exclude_terminals else F.lit(True)


def observed_links(
    events: DataFrame, max_delay_seconds: int = 7200,
    start_date: str | None = None, end_date: str | None = None,
) -> DataFrame:
    """Stop events with previous-stop values and trip bounds.

    The first stop of every trip is dropped only after the trip bounds are known.
    """
    rows = events.filter(
        F.col("event_type").isin("STOPPED", "PASSED")
        & F.col("actual_arrival_utc").isNotNull()
        & (F.abs("arrival_delay_seconds") <= max_delay_seconds)
    )
    if start_date:
        rows = rows.filter(F.col("service_date") >= start_date[:10])
    if end_date:
        rows = rows.filter(F.col("service_date") <= end_date[:10])
    trip = ["trip_id", "service_date"]
    w = tr.along_trip(trip)
    lagged = rows.withColumns(
        {
            "prev_stop_seq": F.lag("stop_sequence").over(w),
            "prev_stop_id": F.lag("stop_id").over(w),
            "raw_prev_stop_delay": F.lag("arrival_delay_seconds").over(w),
            "prev_departure_delay": F.lag(F.coalesce("departure_delay_seconds", "arrival_delay_seconds")).over(w),
            "prev2_stop_delay": F.lag("arrival_delay_seconds", 2).over(w),
            "prev_actual_dep": F.lag("actual_departure_utc").over(w),
            "prev_sched_arr": F.lag("scheduled_arrival_utc").over(w),
            "prev_sched_dep": F.lag("scheduled_departure_utc").over(w),
        }
    )
    return tr.with_trip_bounds(lagged, trip).filter(F.col("prev_stop_id").isNotNull()).withColumn("vehicle_id", F.col("vehicle_number"))


def with_link_features(links: DataFrame) -> DataFrame:
    """Running delay, time and route features; after the headways, so that their shuffle moves source columns only."""
    # A vehicle that waits at its origin leaves at most a minute early, whatever its arrival.
    raw_prev, prev_dep = F.col("raw_prev_stop_delay"), F.col("prev_departure_delay")
    waits_at_origin = (F.col("prev_stop_seq") == F.col("min_seq")) & (raw_prev < -60)
    prev_delay = F.when(waits_at_origin, F.greatest(F.coalesce(prev_dep, raw_prev), F.lit(-60))).otherwise(raw_prev)
    layover = (F.col("prev_sched_dep") > F.col("prev_sched_arr")) & prev_dep.isNotNull()
    since = F.when(layover, prev_dep).otherwise(prev_delay)
    arrival = F.col("arrival_delay_seconds")
    return links.withColumns(
        {
            "prev_stop_delay": prev_delay,
            "delta_t_run": F.coalesce((arrival - since).cast("double"), F.lit(0.0)),
            "delta_t_dwell": F.col("departure_delay_seconds") - arrival,
            "observed_run_time_s": tr.run_time(F.col("actual_arrival_utc"), F.col("prev_actual_dep")),
            **tr.progress_columns(),
            **transit.calendar_columns(clock.epoch_to_local("actual_arrival_utc")),
            "is_tram": transit.is_tram(F.col("route_id"), F.col("vehicle_type")),
            "transit_cohort": transit.cohort(F.col("route_id"), F.col("vehicle_type")),
        }
    )


def with_upstream_headways(links: DataFrame) -> DataFrame:
    """Actual and scheduled gap behind the previous vehicle leaving the previous stop.

    The keys hold the service day, which cuts a busy (route, stop) into days; both orders and
    the hourly median below then share one shuffle.
    """
    keys, tie = ["service_date", "route_id", "prev_stop_id"], ["trip_id", "stop_sequence"]
    actual = tr.with_headway(links, keys, "prev_actual_dep", "raw_headway_actual_s", tie, None)
    both = tr.with_headway(actual, keys, "prev_sched_dep", "raw_headway_sched_s", tie, None)
    a, s = F.col("raw_headway_actual_s"), F.col("raw_headway_sched_s")
    return both.withColumns(
        {
            "headway_actual_s": F.when(a.between(10, 3600), a),
            "headway_sched_s": F.when((F.col("prev_sched_dep") > clock.REAL_CLOCK_MIN) & s.between(30, 3600), s),
        }
    )


def adjacent_stops(exclude_terminals: bool = True) -> Column:
    """Link filter of the observed mart; applied after headways so passes still count there."""
    return (
        (F.col("event_type") == "STOPPED")
        & (F.col("stop_sequence") == F.col("prev_stop_seq") + 1)
        & inner_stops(exclude_terminals)
        & (F.abs("delta_t_run") <= 600)
    )


def with_headway_deviation(rows: DataFrame) -> DataFrame:
    """Deviation from the scheduled gap, else from the hourly median gap, else 0.

    The median group is one hour of one stop, route and day; its window reuses the headway
    shuffle and saves the join back.
    """
    hourly = Window.partitionBy("service_date", "route_id", "prev_stop_id", "hour_of_day")
    gap = F.col("headway_actual_s")
    typical = F.coalesce(F.col("headway_sched_s").cast("double"), F.median(gap).over(hourly))
    deviation = F.when(gap.isNotNull(), F.coalesce(gap - typical, F.lit(0.0)))
    return rows.withColumn("headway_deviation", deviation.cast("double"))


def _context(rows: DataFrame, dims: Dimensions) -> DataFrame:
    """Hour and day dimensions, equal for both marts."""
    weather = dim.weather_by_hour(dims.weather).withColumnRenamed("timestamp", "w_hour")
    calendar = dims.calendar.select("calendar_date", "is_school_day", "is_public_holiday")
    day = clock.day_text(F.col("arrival_ts"))
    return rows.join(weather, F.col("timestamp_bucket") == F.col("w_hour"), "left").join(
        calendar, day == F.col("calendar_date"), "left"
    )


BASE_COLUMNS = [
    "trip_id", "route_id", "vehicle_id", "stop_sequence", "stop_id", "prev_stop_id", "arrival_delay_seconds",
    "departure_delay_seconds", "prev_stop_delay", "prev2_stop_delay", "delta_t_run", "delta_t_dwell",
    "observed_run_time_s", "trip_progress", "is_origin_stop", "is_terminal_stop", "is_tram", "transit_cohort",
    "arrival_ts", "timestamp_bucket", "hour_of_day", "day_of_week", "is_weekend", "is_peak_hour",
    "is_morning_peak", "is_evening_peak", "headway_actual_s", "headway_deviation",
]
OBSERVED_ONLY = ["stop_name", "dwell_seconds", "zbk_forecast_delay_s", "forecast_error_s", "confidence"]


def observed_mart(
    events: DataFrame, dims: Dimensions = Dimensions(), max_delay_seconds: int = 7200,
    exclude_terminals: bool = True, start_date: str | None = None,
    end_date: str | None = None, ordered: bool = False, links_tie: str = "edge_id", hubs_tie: str = "stop_id",
) -> DataFrame:
    """Feature mart on observed stop events. ``ordered`` adds the total order for display;
    for storage prefer ``sinks.write_dataset`` which sorts inside files."""
    dims = dims.filled(events)
    links = observed_links(events, max_delay_seconds, start_date, end_date)
    timed = with_link_features(with_upstream_headways(links)).filter(adjacent_stops(exclude_terminals))
    rows = _context(with_headway_deviation(timed), dims)
    roads = dim.links_by_either_key(dims.links, links_tie).select("join_prev", "join_curr", *LINK_COLUMNS)
    hubs = dim.hubs_by_either_key(dims.hubs, hubs_tie).select("join_stop_id", *HUB_COLUMNS)
    joined = rows.join(
        roads, (F.col("prev_stop_id") == F.col("join_prev")) & (F.col("stop_id") == F.col("join_curr")), "left"
    ).join(hubs, F.col("stop_id") == F.col("join_stop_id"), "left")
    mart = joined.select(
        *BASE_COLUMNS, *OBSERVED_ONLY, *dim.dimension_columns(F.col("is_tram"), F.col("is_weekend"))
    )
    return mart.orderBy("arrival_ts", "trip_id", "stop_sequence") if ordered else mart


def links_by_any_key(rows: DataFrame, links: DataFrame) -> DataFrame:
    """LEFT join on slug pair OR stop-id pair, keeping one row per matching link.

    The disjunction is two equi joins: each link enters once per distinct key it offers, so a
    link whose slugs equal its ids still matches once.
    """
    links = dim.complete_links(links)
    cols = ["edge_id", *LINK_COLUMNS]
    slug = links.select(F.col("slug_prev").alias("join_prev"), F.col("slug_curr").alias("join_curr"), *cols)
    same = F.col("slug_prev").eqNullSafe(F.col("stop_id_prev")) & F.col("slug_curr").eqNullSafe(F.col("stop_id_curr"))
    ids = links.filter(~same).select(
        F.col("stop_id_prev").alias("join_prev"), F.col("stop_id_curr").alias("join_curr"), *cols)
    either = slug.unionByName(ids)
    return rows.join(
        either, (F.col("prev_stop_id") == F.col("join_prev")) & (F.col("stop_id") == F.col("join_curr")), "left"
    )


def hubs_by_any_key(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    hubs = dim.with_optional(hubs, {"zbk_slug": F.col("stop_id")})
    slug = hubs.select(F.col("zbk_slug").alias("join_stop_id"), *HUB_COLUMNS)
    ids = hubs.filter(~F.col("stop_id").eqNullSafe(F.col("zbk_slug"))).select(
        F.col("stop_id").alias("join_stop_id"), *HUB_COLUMNS)
    return rows.join(slug.unionByName(ids), F.col("stop_id") == F.col("join_stop_id"), "left")


def legacy_mart(
    updates: DataFrame, dims: Dimensions = Dimensions(), max_delay_seconds: int = 7200,
    exclude_terminals: bool = True, start_date: str | None = None,
    end_date: str | None = None, ordered: bool = False, deviation: bool = True,
) -> DataFrame:
    """Feature mart on predicted delay updates; without ``deviation`` from the median headway, whose groups take all links a second time, that column is left out."""
    dims = dims.filled(updates)
    clean = tr.with_trip_instance(updates).filter(F.abs("arrival_delay_seconds") <= max_delay_seconds)
    if start_date or end_date:
        clean = clean.filter(transit.local_range(F.col("feed_timestamp"), start_date, end_date))
    latest = tr.last_ping_per_stop(clean)
    lagged = tr.with_update_lags(latest).filter(F.col("prev_stop_id").isNotNull())
    rows = lagged.withColumns(
        {
            **tr.update_delta_columns(), **tr.progress_columns(),
            **transit.calendar_columns(clock.epoch_to_local("rt_arrival_time")),
            "is_tram": transit.is_tram(F.col("route_id")),
            "transit_cohort": transit.cohort(F.col("route_id")),
        }
    )
    timed = tr.with_headway(
        rows, ["route_id", "prev_stop_id"], "prev_rt_departure", "raw_headway_actual_s",
        ["trip_id", "stop_sequence", tr.TRIP_DAY],
    )
    gap = F.col("raw_headway_actual_s")
    timed = timed.withColumn("headway_actual_s", F.when(gap.between(10, 3600), gap))
    kept = timed.filter(inner_stops(exclude_terminals) & (F.abs("delta_t_run") <= 1800))
    # The either-key joins may repeat a row, and the medians count such repeats, so joins come first.
    joined = hubs_by_any_key(links_by_any_key(_context(kept, dims), dims.links), dims.hubs)
    if deviation:
        scored = tr.with_group_median(joined, ["route_id", "prev_stop_id", "hour_of_day"], "headway_actual_s", "__median")
        joined = scored.withColumn("headway_deviation", (F.col("headway_actual_s") - F.col("__median")).cast("double"))
    mart = joined.select(*[c for c in BASE_COLUMNS if deviation or c != "headway_deviation"], *dim.dimension_columns(F.col("is_tram"), F.col("is_weekend")))
    return mart.orderBy("arrival_ts") if ordered else mart


def mart_summary(mart: DataFrame) -> DataFrame:
    d = F.col("delta_t_run")
    dwell = round_half_up(F.avg("dwell_seconds"), 2) if "dwell_seconds" in mart.columns else F.lit(0.0)

    def percent(cond: Column) -> Column:
        return round_half_up(F.count_if(cond) * 100.0 / F.count(F.lit(1)), 1)

    return mart.agg(
        F.count(F.lit(1)).alias("total_observations"),
        F.countDistinct("trip_id").alias("distinct_trips"),
        F.countDistinct("route_id").alias("distinct_routes"),
        F.sum("is_study_corridor").alias("study_corridor_observations"),
        round_half_up(F.avg(d), 2).alias("avg_delta_t_run"),
        round_half_up(F.median(d), 2).alias("median_delta_t_run"),
        round_half_up(F.stddev(d), 2).alias("std_delta_t_run"),
        round_half_up(F.avg("segment_length_meters"), 1).alias("avg_segment_meters"),
        round_half_up(F.avg("signalized_intersection_count"), 2).alias("avg_signals"),
        round_half_up(F.avg("temperature_c"), 1).alias("avg_temperature_c"),
        percent(F.col("is_peak_hour") == 1).alias("peak_hour_pct"),
        percent(F.col("is_tram") == 1).alias("tram_share_pct"),
        dwell.alias("avg_dwell_s"),
    )


def mart_by_corridor(mart: DataFrame) -> DataFrame:
    return mart.groupBy(F.coalesce("corridor_name", F.lit("non_study_network")).alias("corridor")).agg(
        F.count(F.lit(1)).alias("obs"),
        round_half_up(F.avg("delta_t_run"), 2).alias("avg_delta_t_run"),
        round_half_up(F.avg("segment_length_meters"), 1).alias("avg_length_m"),
        round_half_up(F.avg("signalized_intersection_count"), 2).alias("avg_signals"),
    )
