"""Trip windows: repeated pings, lags along a trip, running and dwell delay, headways."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import clock
from fleetlens.functions.rounding import round_half_up
from fleetlens.operators.chunked import with_neighbours
from fleetlens.operators.latest import latest_per_key
from fleetlens.session import sized, written

HOUR = 3600
# A trip instance: two columns instead of one text of both, so that rows partitioned by trip id serve as they are.
TRIP_DAY = "trip_day"
TRIP = ["trip_id", TRIP_DAY]


def with_trip_instance(updates: DataFrame) -> DataFrame:
    """Add ``start_date`` (derived when absent) and the day of the trip instance."""
    if "start_date" in updates.columns:
        day = F.coalesce("start_date", clock.day_text(clock.epoch_to_utc("feed_timestamp")))
        keep = F.col("start_date")
    else:
        day = clock.day_text(clock.epoch_to_utc(F.coalesce("rt_arrival_time", "feed_timestamp")))
        keep = day
    return updates.withColumns({"start_date": keep, TRIP_DAY: F.when(F.col("trip_id").isNotNull(), day)})


def last_ping_per_stop(updates: DataFrame) -> DataFrame:
    """One update per trip instance and stop sequence: the one with the latest feed time.

    Remaining columns break ties so the choice is repeatable.
    """
    ties = ["arrival_delay_seconds", "stop_id", "departure_delay_seconds", "rt_arrival_time", "rt_departure_time"]
    return latest_per_key(updates, [*TRIP, "stop_sequence"], [F.col("feed_timestamp"), *[F.col(t) for t in ties]])


def along_trip(trip: Sequence[str] = TRIP) -> Window:
    return Window.partitionBy(*trip).orderBy("stop_sequence")


def with_trip_bounds(df: DataFrame, trip: Sequence[str] = TRIP) -> DataFrame:
    whole = Window.partitionBy(*trip)
    return df.withColumns(
        {"max_seq": F.max("stop_sequence").over(whole), "min_seq": F.min("stop_sequence").over(whole)}
    )


def progress_columns() -> dict[str, Column]:
    span = F.col("max_seq") - F.col("min_seq")
    done = (F.col("stop_sequence") - F.col("min_seq")).cast("double")
    return {
        "trip_progress": F.when(span > 0, round_half_up(done / F.nullif(span, F.lit(0)), 3)).otherwise(0.0),
        "is_origin_stop": F.col("stop_sequence") == F.col("min_seq"),
        "is_terminal_stop": (F.col("stop_sequence") == F.col("max_seq")) & (span > 0),
    }


def run_time(arrival: Column, previous_departure: Column) -> Column:
    return F.when(arrival > previous_departure, arrival - previous_departure)


def with_update_lags(updates: DataFrame) -> DataFrame:
    """Previous-stop values of deduplicated delay updates plus trip bounds."""
    w = along_trip()
    filled = updates.withColumns(
        {
            "departure_delay_seconds": F.coalesce("departure_delay_seconds", "arrival_delay_seconds"),
            "rt_departure_time": F.coalesce("rt_departure_time", "rt_arrival_time"),
        }
    )
    lagged = filled.withColumns(
        {
            "prev_stop_id": F.lag("stop_id").over(w),
            "prev_stop_delay": F.lag("arrival_delay_seconds").over(w),
            "prev_departure_delay": F.lag("departure_delay_seconds").over(w),
            "prev2_stop_delay": F.lag("arrival_delay_seconds", 2).over(w),
            "prev_rt_departure": F.lag("rt_departure_time").over(w),
        }
    )
    return with_trip_bounds(lagged)


def update_delta_columns() -> dict[str, Column]:
    """Running delay, dwell delay and observed run time of delay updates."""
    arrival = F.col("arrival_delay_seconds")
    since = F.coalesce("prev_departure_delay", "prev_stop_delay")
    return {
        "delta_t_run": F.coalesce((arrival - since).cast("double"), F.lit(0.0)),
        "delta_t_dwell": F.col("departure_delay_seconds") - arrival,
        "observed_run_time_s": run_time(F.col("rt_arrival_time"), F.col("prev_rt_departure")),
    }


def with_headway(
    df: DataFrame, keys: Sequence[str], time: str, name: str, tie: Sequence[str], chunk_seconds: int | None = HOUR
) -> DataFrame:
    """Seconds since the previous row of the same keys.

    Hot keys are cut into time chunks; with ``chunk_seconds=None`` (keys that already hold a
    service day) one plain window does.
    """
    t = F.col(time)
    order = [t.asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie]]
    if chunk_seconds is None:
        return df.withColumn(name, t - F.lag(t).over(Window.partitionBy(*keys).orderBy(*order)))
    prev = "__prev_time"
    # Rows without a time sort last in their own chunk, and their headway is null anyway.
    chunk = F.coalesce(F.floor(t / F.lit(chunk_seconds)), F.lit(2**62))
    near = with_neighbours(df, keys, order, chunk, lag={prev: t})
    return near.withColumn(name, t - F.col(prev)).drop(prev)


def with_group_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median of ``value`` per key, attached to every row.

    The aggregate combines map-side (value counts), so no task ever sees a whole hot key; the
    attaching join is left to adaptive execution (broadcast if small, skew split otherwise).
    """
    return with_medians(df, group_medians(df, keys, value, name), keys)


def group_medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*[F.col(k).alias(f"__m_{k}") for k in keys]).agg(F.median(value).alias(name))


def with_medians(df: DataFrame, medians: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__m_{k}"))
    return df.join(medians, cond, "left").drop(*[f"__m_{k}" for k in keys])


def reconstruct(updates: DataFrame, max_delay_seconds: int = 7200) -> DataFrame:
    """Full decomposition of delay updates: last ping, lags, progress, deltas, headway.

    The medians need all headways first, so rows are stored with theirs once instead of being made and shuffled twice; the medians are broadcast if their files are small.
    """
    clean = with_trip_instance(updates).filter(F.abs("arrival_delay_seconds") <= max_delay_seconds)
    latest = last_ping_per_stop(clean)
    lagged = with_update_lags(latest)
    parts = lagged.withColumns({**update_delta_columns(), **progress_columns()})
    timed = with_headway(
        parts, ["route_id", "stop_id"], "rt_arrival_time", "headway_actual_s", ["trip_id", "stop_sequence", TRIP_DAY]
    )
    rows, stop = written(timed, "headways"), ["route_id", "stop_id"]
    scored = with_medians(rows, sized(written(group_medians(rows, stop, "headway_actual_s", "__median"), "headway-medians")), stop)
    dev = F.when(F.col("headway_actual_s").between(10, 7200), F.col("headway_actual_s") - F.col("__median"))
    return scored.select(
        "feed_timestamp", "trip_id", "route_id", "vehicle_id", "stop_sequence", "stop_id", "prev_stop_id",
        "arrival_delay_seconds", "departure_delay_seconds", "prev_stop_delay", "prev2_stop_delay",
        "rt_arrival_time", "rt_departure_time", "delta_t_run", "delta_t_dwell", "observed_run_time_s",
        "trip_progress", "is_origin_stop", "is_terminal_stop", "headway_actual_s",
        dev.cast("double").alias("headway_deviation"),
    )


def trajectory_summary(trajectory: DataFrame) -> DataFrame:
    d = F.col("delta_t_run")
    return trajectory.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("trip_id").alias("distinct_trips"),
        F.countDistinct("route_id").alias("distinct_routes"),
        round_half_up(F.avg(d), 2).alias("mean_delta_t_run"),
        round_half_up(F.median(d), 2).alias("median_delta_t_run"),
        round_half_up(F.stddev(d), 2).alias("std_delta_t_run"),
        round_half_up(F.avg("delta_t_dwell"), 2).alias("mean_delta_t_dwell"),
        round_half_up(F.avg("headway_actual_s"), 1).alias("mean_headway_s"),
        round_half_up(F.median("headway_actual_s"), 1).alias("median_headway_s"),
        F.count("prev_stop_id").alias("segments_with_prev_stop"),
    )
