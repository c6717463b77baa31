"""Canned analytical reports over the marts, events, links and weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import clock
from fleetlens.functions.rounding import correlation
from fleetlens.functions.rounding import round_half_up as rnd

MAIN_COHORTS = ["urban_tram", "urban_bus", "suburban_bus"]


def rows_count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def minutes(c: str = "arrival_delay_seconds") -> Column:
    return F.col(c) / F.lit(60.0)


def share(cond: Column) -> Column:
    """Mean of a 0/1 condition in percent, unknown counting as false."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100


def operational(mart: DataFrame, limit: int = 1800) -> DataFrame:
    return mart.filter(F.abs("arrival_delay_seconds") <= limit)


def _delay_minutes() -> list[Column]:
    return [rnd(F.avg(minutes()), 2).alias("mean_delay_min"), rnd(F.median(minutes()), 2).alias("median_delay_min")]


def daily_ingestion(updates: DataFrame) -> DataFrame:
    """Volume per ingestion day; expects year, month, day partition columns."""
    return updates.groupBy("year", "month", "day").agg(
        rows_count("records_ingested"),
        F.countDistinct("route_id").alias("distinct_routes"),
        F.countDistinct("vehicle_id").alias("active_vehicles"),
        rnd(F.avg("arrival_delay_seconds"), 1).alias("mean_delay_s"),
    )


def cohort_overview(mart: DataFrame) -> DataFrame:
    return mart.groupBy("transit_cohort").agg(
        rows_count("total_segments"),
        rnd(F.avg("arrival_delay_seconds"), 2).alias("avg_delay_seconds"),
        rnd(F.median("arrival_delay_seconds"), 2).alias("median_delay_seconds"),
        rnd(F.avg("prev_stop_delay"), 2).alias("avg_upstream_delay"),
        rnd(F.avg("segment_length_meters"), 1).alias("avg_segment_meters"),
        rnd(share(F.col("is_dedicated_right_of_way")), 1).alias("pct_dedicated_row"),
    )


def right_of_way_by_peak(mart: DataFrame) -> DataFrame:
    return operational(mart).groupBy("is_dedicated_right_of_way", "is_peak_hour").agg(
        rows_count("segment_count"),
        rnd(F.avg("arrival_delay_seconds"), 2).alias("mean_delay_seconds"),
        rnd(F.median("arrival_delay_seconds"), 2).alias("median_delay_seconds"),
    )


def right_of_way_matrix(mart: DataFrame) -> DataFrame:
    lane = F.when(F.col("is_dedicated_right_of_way"), "Dedicated Right-of-Way").otherwise("Mixed General Traffic")
    period = F.when(F.col("is_peak_hour") == 1, "Rush Hour (Peak)").otherwise("Off-Peak")
    return operational(mart).groupBy(lane.alias("right_of_way"), period.alias("traffic_period")).agg(
        rows_count("observations"), *_delay_minutes(), rnd(F.avg("delta_t_run"), 2).alias("mean_segment_run_s"))


def weather_by_station(weather: DataFrame) -> DataFrame:
    return weather.groupBy("station_name").agg(
        rows_count("total_hours"),
        F.min("timestamp").alias("earliest_record"),
        F.max("timestamp").alias("latest_record"),
        rnd(F.avg("temperature_c"), 1).alias("avg_temperature_c"),
        rnd(F.sum("precipitation_mm"), 1).alias("total_rainfall_mm"),
    )


def one_trip(rows: DataFrame, trip_id: str) -> DataFrame:
    return rows.filter(F.col("trip_id") == trip_id)


def track_inventory(tracks: dict[str, DataFrame]) -> DataFrame:
    """One summary row per named mart."""
    d = F.col("arrival_delay_seconds")
    parts = [
        mart.agg(
            F.lit(name).alias("dataset_track"),
            rows_count("total_records"),
            F.countDistinct("route_id").alias("distinct_routes"),
            F.countDistinct("trip_id").alias("distinct_trips"),
            F.countDistinct("stop_id").alias("distinct_stops"),
            F.min("arrival_ts").cast("string").alias("earliest_arrival"),
            F.max("arrival_ts").cast("string").alias("latest_arrival"),
            rnd(F.avg(d), 1).alias("mean_delay_s"),
            rnd(F.median(d), 1).alias("median_delay_s"),
            rnd(F.stddev(d), 1).alias("std_delay_s"),
        )
        for name, mart in tracks.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUANTILES = {"p01_min": 0.01, "p05_min": 0.05, "p10_min": 0.10, "p25_min": 0.25, "p50_median_min": 0.50,
             "p75_min": 0.75, "p90_min": 0.90, "p95_min": 0.95, "p99_min": 0.99}


def delay_quantiles(mart: DataFrame) -> DataFrame:
    """Exact quantiles; delays are whole seconds, so the value counts behind them stay small."""
    q = operational(mart).agg(
        rows_count("total_records"),
        rnd(F.avg(minutes()), 2).alias("mean_min"),
        rnd(F.stddev(minutes()), 2).alias("std_min"),
        F.percentile(minutes(), list(QUANTILES.values())).alias("q"),
    )
    return q.select("total_records", "mean_min", "std_min",
                    *[rnd(F.get("q", F.lit(i)), 2).alias(n) for i, n in enumerate(QUANTILES)])


def cohort_punctuality(mart: DataFrame) -> DataFrame:
    d = F.col("arrival_delay_seconds")
    per = operational(mart).groupBy("transit_cohort").agg(
        rows_count("obs_count"),
        *_delay_minutes(),
        rnd(F.percentile(minutes(), F.lit(0.9)), 2).alias("p90_delay_min"),
        rnd(share(d <= 180), 1).alias("pct_punctual_3min"),
        rnd(share(d > 300), 1).alias("pct_late_5min"),
        rnd(F.avg("segment_length_meters"), 1).alias("mean_segment_m"),
        rnd(share(F.col("is_dedicated_right_of_way")), 1).alias("pct_dedicated_row"),
    )
    # Five cohort rows: a keyless window over the aggregate, not over the mart.
    total = F.sum("obs_count").over(Window.partitionBy())
    return per.withColumn("pct_share", rnd(F.lit(100.0) * F.col("obs_count") / total, 1))


def delay_persistence(mart: DataFrame) -> DataFrame:
    d = F.col("arrival_delay_seconds")
    rows = operational(mart).filter(F.abs("prev_stop_delay") <= 1800)
    return rows.groupBy("transit_cohort").agg(
        rows_count("observations"),
        rnd(correlation("prev_stop_delay", "arrival_delay_seconds"), 4).alias("lag1_correlation"),
        rnd(correlation("prev2_stop_delay", "arrival_delay_seconds"), 4).alias("lag2_correlation"),
        rnd(F.regr_slope(d, F.col("prev_stop_delay")), 4).alias("persistence_slope_rho"),
        rnd(F.regr_r2(d, F.col("prev_stop_delay")), 4).alias("lag1_r_squared"),
    )


def delay_by_progress(mart: DataFrame) -> DataFrame:
    rows = operational(mart).filter(F.col("transit_cohort").isin(MAIN_COHORTS))
    return rows.groupBy("transit_cohort", rnd(F.col("trip_progress"), 1).alias("progress_decile")).agg(
        rows_count("count"), *_delay_minutes())


def weather_by_cohort(mart: DataFrame) -> DataFrame:
    label = F.when(F.col("is_raining") == 1, "Active Rain").otherwise("Dry Conditions")
    rows = operational(mart).filter(F.col("transit_cohort").isin(MAIN_COHORTS))
    return rows.groupBy("transit_cohort", label.alias("weather_condition")).agg(
        rows_count("observations"), *_delay_minutes(), rnd(F.avg("delta_t_run"), 2).alias("mean_run_delay_s"))


# Labels of the rain classes in reports.
RAIN_LABELS = ["0: None (Dry)", "1: Light (<= 0.5 mm)", "2: Moderate (0.5-2.0 mm)", "3: Heavy (> 2.0 mm)"]


def rain_tiers(mart: DataFrame) -> DataFrame:
    label = F.get(F.array(*[F.lit(x) for x in RAIN_LABELS]), F.col("rain_intensity_category").cast("int"))
    return operational(mart).groupBy(label.alias("rain_tier")).agg(
        rows_count("record_count"), rnd(F.avg("precipitation_mm"), 2).alias("avg_precip_mm"), *_delay_minutes(),
        rnd(F.avg("delta_t_run"), 2).alias("mean_delta_run_s"))


def temperature_curve(mart: DataFrame) -> DataFrame:
    """Every whole degree that occurs, with its row count."""
    return operational(mart).groupBy(rnd(F.col("temperature_c")).alias("temp_c")).agg(
        rows_count("count"), *_delay_minutes())


def corridor_league(mart: DataFrame) -> DataFrame:
    return operational(mart.filter(F.col("corridor_name").isNotNull())).groupBy("corridor_name").agg(
        rows_count("observations"), *_delay_minutes(),
        rnd(F.avg("delta_t_run"), 2).alias("mean_delta_run_s"),
        rnd(F.avg("signalized_intersection_count"), 1).alias("avg_signals_per_link"),
        rnd(F.avg("segment_length_meters"), 1).alias("avg_stop_spacing_m"),
        rnd(share(F.col("is_dedicated_right_of_way")), 1).alias("pct_dedicated_row"))


def metro_adjacency(mart: DataFrame) -> DataFrame:
    label = F.when(F.col("is_metro_proximity") == 1, "Metro Adjacent (<= 300m)").otherwise("Standard Surface Stop")
    return operational(mart).groupBy(label.alias("metro_status")).agg(
        rows_count("observations"),
        rnd(F.avg("dwell_seconds"), 1).alias("mean_dwell_s"),
        rnd(F.median("dwell_seconds"), 1).alias("median_dwell_s"),
        rnd(F.avg(minutes()), 2).alias("mean_delay_min"),
        rnd(F.avg("interchange_line_count"), 1).alias("mean_routes_served"))


def headway_regimes(mart: DataFrame) -> DataFrame:
    h = F.col("headway_deviation")
    label = (F.when(h < -0.2, "Bunched (< -20% Headway)").when(h <= 0.2, "Regular (±20% Headway)")
             .otherwise("Gapped (> +20% Headway)"))
    return operational(mart).filter(h.isNotNull()).groupBy(label.alias("headway_regime")).agg(
        rows_count("observations"), *_delay_minutes(), rnd(F.avg("delta_t_run"), 2).alias("mean_delta_run_s"))


def forecast_accuracy(mart: DataFrame) -> DataFrame:
    e = F.col("forecast_error_s")
    return mart.filter(e.isNotNull()).groupBy(F.col("confidence").alias("confidence_tier")).agg(
        rows_count("record_count"),
        rnd(F.avg("arrival_delay_seconds"), 1).alias("obs_delay_mean_s"),
        rnd(F.avg("zbk_forecast_delay_s"), 1).alias("forecast_delay_mean_s"),
        rnd(F.avg(e), 1).alias("mean_error_bias_s"),
        rnd(F.avg(F.abs(e)), 1).alias("mae_seconds"),
        rnd(F.sqrt(F.avg(e * e)), 1).alias("rmse_seconds"),
        rnd(correlation("arrival_delay_seconds", "zbk_forecast_delay_s"), 3).alias("pearson_correlation"))


def corridor_infrastructure(links: DataFrame) -> DataFrame:
    km = F.sum("segment_length_meters") / F.lit(1000.0)
    return links.filter(F.col("corridor_name").isNotNull()).groupBy("corridor_name").agg(
        rows_count("segment_count"),
        rnd(km, 2).alias("corridor_km"),
        rnd(F.avg("segment_length_meters"), 1).alias("mean_stop_spacing_m"),
        F.sum("signalized_intersection_count").alias("total_signals"),
        rnd(F.sum("signalized_intersection_count") / km, 2).alias("signals_per_km"),
        rnd(F.avg("lane_capacity"), 1).alias("avg_lanes"),
        rnd(F.lit(100.0) * F.count_if("is_dedicated_right_of_way") / F.count(F.lit(1)), 1).alias("dedicated_row_pct"))


def link_summary(links: DataFrame) -> DataFrame:
    length, signals = F.col("segment_length_meters"), F.col("signalized_intersection_count")
    tort = rnd(F.avg("tortuosity_ratio"), 3) if "tortuosity_ratio" in links.columns else F.lit(1.0)
    return links.agg(
        rows_count("total_segments"),
        F.countDistinct("corridor_name").alias("total_corridors"),
        rnd(F.sum(length) / F.lit(1000.0), 2).alias("total_network_km"),
        rnd(F.avg(length), 1).alias("avg_segment_meters"),
        rnd(F.min(length), 1).alias("min_segment_meters"),
        rnd(F.max(length), 1).alias("max_segment_meters"),
        rnd(F.avg(signals), 2).alias("avg_signals_per_segment"),
        F.sum(signals).alias("total_signals_detected"),
        F.count_if("is_dedicated_right_of_way").alias("dedicated_row_segments"),
        rnd(F.avg("lane_capacity"), 2).alias("avg_lane_capacity"),
        tort.alias("avg_tortuosity"))


def link_summary_by_corridor(links: DataFrame) -> DataFrame:
    return links.groupBy(F.coalesce("corridor_name", F.lit("network_general")).alias("corridor_name")).agg(
        rows_count("segments"),
        rnd(F.sum("segment_length_meters") / F.lit(1000.0), 2).alias("length_km"),
        rnd(F.avg("signalized_intersection_count"), 1).alias("avg_signals"))


def weather_range(weather: DataFrame, start: str, ordered: bool = False) -> DataFrame:
    rows = weather.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    return rows.orderBy("timestamp") if ordered else rows


def weather_summary(weather: DataFrame) -> DataFrame:
    temp, rain = F.col("temperature_c"), F.col("precipitation_mm")
    return weather.agg(
        rows_count("total_records"),
        F.min("timestamp").alias("earliest_timestamp"),
        F.max("timestamp").alias("latest_timestamp"),
        rnd(F.avg(temp), 2).alias("avg_temperature"),
        rnd(F.min(temp), 2).alias("min_temperature"),
        rnd(F.max(temp), 2).alias("max_temperature"),
        rnd(F.avg(rain), 2).alias("avg_precipitation"),
        rnd(F.max(rain), 2).alias("max_precipitation"),
        F.countDistinct("station_name").alias("active_stations"))


def catalog_stats(updates: DataFrame) -> DataFrame:
    """Row statistics of a raw delay store plus its file count and bytes (from file metadata)."""
    d = F.col("arrival_delay_seconds")
    stats = updates.agg(
        rows_count("total_rows"),
        F.countDistinct("trip_id").alias("distinct_trips"),
        F.countDistinct("route_id").alias("distinct_routes"),
        F.min(d).alias("min_delay_sec"), F.max(d).alias("max_delay_sec"), F.avg(d).alias("avg_delay_sec"))
    return stats


def file_stats(store: DataFrame) -> DataFrame:
    """Files and bytes behind a file-based table."""
    files = store.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(rows_count("total_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"))


def feed_stats(updates: DataFrame) -> DataFrame:
    """What one feed snapshot delivered."""
    return updates.groupBy("feed_timestamp").agg(
        F.countDistinct("trip_id").alias("total_trip_updates"),
        rows_count("total_stop_records"),
        F.count("arrival_delay_seconds").alias("records_with_delay"),
        F.countDistinct("vehicle_id").alias("active_vehicles"),
        F.countDistinct("route_id").alias("active_routes"))


def rain_disparity(mart: DataFrame) -> DataFrame:
    return mart.groupBy("transit_cohort", "is_raining").agg(
        rows_count("total_observations"),
        rnd(F.avg("arrival_delay_seconds"), 1).alias("mean_delay_seconds"),
        rnd(F.median("arrival_delay_seconds"), 1).alias("median_delay_seconds"),
        rnd(share(F.col("is_dedicated_right_of_way")), 1).alias("pct_dedicated_row"))


def daily_stop_events(events: DataFrame) -> DataFrame:
    """Gold volume by day. The interpolated share counts STOPPED events, whose times are interpolated."""
    return events.groupBy(F.col("service_date").alias("date")).agg(
        rows_count("stop_events"),
        F.countDistinct("trip_id").alias("complete_trips"),
        F.countDistinct("route_id").alias("routes_served"),
        rnd(F.avg("arrival_delay_seconds"), 1).alias("mean_delay_seconds"),
        rnd(share(F.col("event_type") == "STOPPED"), 2).alias("pct_interpolated"))


CORRELATED = ["arrival_delay_seconds", "delta_t_run", "prev_stop_delay", "dwell_seconds", "trip_progress",
              "headway_deviation", "segment_length_meters", "signalized_intersection_count",
              "interchange_line_count", "is_metro_proximity", "temperature_c", "precipitation_mm",
              "wind_speed_ms", "relative_humidity"]


def feature_correlation(mart: DataFrame, features: list[str] = CORRELATED) -> DataFrame:
    """Correlation matrix in long form: all pairs in one aggregate pass over all rows."""
    rows = operational(mart).filter((F.abs("prev_stop_delay") <= 1800) & F.col("headway_deviation").isNotNull())
    n = len(features)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    flat = rows.agg(*[correlation(features[i], features[j]).alias(f"c_{i}_{j}") for i, j in pairs])

    def entry(i: int, j: int) -> Column:
        return F.lit(1.0) if i == j else F.col(f"c_{min(i, j)}_{max(i, j)}")

    cells = [F.struct(F.lit(features[i]).alias("feature"),
                      *[rnd(entry(i, j), 3).alias(features[j]) for j in range(n)]) for i in range(n)]
    return flat.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def link_weather_preview(updates: DataFrame, links: DataFrame, weather: DataFrame, limit: int = 10) -> DataFrame:
    """First rows of updates joined to their link and to the weather of their UTC hour."""
    at = clock.epoch_to_utc("rt_arrival_time")
    hours = weather.withColumnRenamed("timestamp", "w_hour")
    rows = updates.filter(F.abs("arrival_delay_seconds") <= 1800).withColumn("arrival_time", at)
    # The leading sort columns come from the updates and each linked update gives a row, so the first ``limit`` of them bound the result.
    key = F.struct("trip_id", "route_id", "stop_id", "arrival_delay_seconds", "arrival_time")
    linked = rows.join(links, F.col("stop_id") == F.col("stop_id_curr"), "left_semi").withColumn("__key", key)
    last = linked.select("__key").orderBy("__key").limit(limit).agg(F.max("__key").alias("__last"))
    few = linked.join(F.broadcast(last), F.col("__key") <= F.col("__last")).drop("__key", "__last")  # one row
    joined = few.join(links, F.col("stop_id") == F.col("stop_id_curr")).join(
        hours, clock.hour_bucket(F.col("arrival_time")) == F.col("w_hour"), "left")
    out = joined.select(
        "trip_id", "route_id", "stop_id", F.col("arrival_delay_seconds").alias("delay_s"), "arrival_time",
        "temperature_c", "precipitation_mm", "corridor_name", "segment_length_meters",
        F.col("signalized_intersection_count").alias("signals"),
        F.col("is_dedicated_right_of_way").alias("dedicated_row"))
    return out.orderBy(*out.columns).limit(limit)


def source_coverage(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows, keys and time range per source (name to table, key column, epoch column), the range
    all sources share, and whether there is one."""
    out = None
    for name, (df, key, time) in sources.items():
        row = df.agg(F.lit(name).alias("source"), rows_count("rows"), F.countDistinct(key).alias("keys"),
                     F.min(time).cast("long").alias("first_epoch"), F.max(time).cast("long").alias("last_epoch"))
        out = row if out is None else out.unionByName(row)
    # One row per source: a keyless window is enough.
    every = Window.partitionBy()
    return out.withColumns({"overlap_start": F.max("first_epoch").over(every), "overlap_end": F.min("last_epoch").over(every)}).withColumn(
        "is_ready", F.col("overlap_start") <= F.col("overlap_end"))


def source_days(sources: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(source, day, rows): how many rows each source holds per day; rows without a day are left out."""
    out = None
    for name, (df, day) in sources.items():
        row = df.select(day.alias("day")).filter("day IS NOT NULL").groupBy("day").agg(rows_count("rows")).select(F.lit(name).alias("source"), "day", "rows")
        out = row if out is None else out.unionByName(row)
    return out


def day_spans(days: DataFrame, key: str = "source") -> DataFrame:
    """(key, first_day, last_day, days): runs of neighbouring days. ``days`` holds each (key, day) once."""
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    return days.select(key, "day", island.alias("__island")).groupBy(key, "__island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), rows_count("days")).drop("__island")


def study_window(days: DataFrame, lead: str) -> DataFrame:
    """One row per source: its days, gaps and how far it lags behind ``lead``; the window from the last start to the first end, whether it is there at all,
    and the longest run of days that every source holds (of equal runs the earliest). A window that is not there recommends nothing.

    Only days per source are left after ``source_days``, so the windows here are small.
    """
    spans = day_spans(days).groupBy("source").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("days").alias("n_days"), rows_count("n_spans"))
    rows = days.groupBy("source").agg(F.sum("rows").alias("rows"))
    n = days.agg(F.countDistinct("source").alias("__n"))
    shared = days.groupBy("day").agg(F.countDistinct("source").alias("__k")).join(n).filter("__k = __n").select(F.lit("all").alias("source"), "day")  # one row of counts
    best = day_spans(shared).agg(F.max_by(F.struct("first_day", "last_day"), F.struct("days", -F.unix_date("first_day"))).alias("__best"))
    every = Window.partitionBy()
    lead_end = F.max(F.when(F.col("source") == lead, F.col("last_day"))).over(every)
    out = spans.join(rows, "source").withColumns({
        "missing_days": F.datediff("last_day", "first_day") + 1 - F.col("n_days"), "lag_days": F.greatest(F.lit(0), F.datediff(lead_end, "last_day")),
        "common_start": F.max("first_day").over(every), "common_end": F.min("last_day").over(every)}).withColumn("is_ready", F.col("common_start") <= F.col("common_end"))
    return out.join(best).withColumns({"recommended_start": F.when(F.col("is_ready"), F.col("__best.first_day")), "recommended_end": F.when(F.col("is_ready"), F.col("__best.last_day"))}).drop("__best")
