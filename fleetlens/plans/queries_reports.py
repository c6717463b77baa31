"""Registered queries: reports over stored marts and over the source views."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import clock
from fleetlens.operators.dimensions import hourly_rollup
from fleetlens.plans import domain, mart, reports
from fleetlens.plans.queries_mart import LEGACY_STEPS, LEGACY_VIEWS, legacy, observed, observed_oracle
from fleetlens.plans.queries_mart import OBSERVED_MART_STEPS, OBSERVED_VIEWS
from fleetlens.plans.registry import comparable, query
from fleetlens.plans.views_sql import with_views
from fleetlens.session import stored

D = "arrival_delay_seconds"
OPERATIONAL = f"abs({D}) <= 1800"
MINUTES = f"""round(avg({D}/60.0::DOUBLE),2) AS mean_delay_min, round(median({D}/60.0::DOUBLE),2) AS median_delay_min"""
ROW_SHARE = "round(avg(CASE WHEN is_dedicated_right_of_way THEN 1.0 ELSE 0.0 END)*100,1) AS pct_dedicated_row"
COHORTS = "transit_cohort IN ('urban_tram','urban_bus','suburban_bus')"


def stored_observed(spark, sf):
    return stored(spark, f"observed_{sf}", lambda: observed(spark, sf))


def mart_report(name: str, sql: str, fn) -> None:
    query(name, observed_oracle(sql))(lambda spark, sf: comparable(fn(stored_observed(spark, sf))))


def view_report(name: str, views: list[str], sql: str, fn) -> None:
    query(name, with_views(views, sql))(lambda spark, sf: comparable(fn(spark, sf)))


mart_report("q2_cohort_overview", f"""SELECT transit_cohort, count(*) AS total_segments, round(avg({D}),2) AS avg_delay_seconds,
 round(median({D}),2) AS median_delay_seconds, round(avg(prev_stop_delay),2) AS avg_upstream_delay,
 round(avg(segment_length_meters),1) AS avg_segment_meters, {ROW_SHARE} FROM mart GROUP BY 1""", reports.cohort_overview)
mart_report("q3_right_of_way_by_peak", f"""SELECT is_dedicated_right_of_way, is_peak_hour, count(*) AS segment_count,
 round(avg({D}),2) AS mean_delay_seconds, round(median({D}),2) AS median_delay_seconds FROM mart WHERE {OPERATIONAL} GROUP BY 1, 2""",
            reports.right_of_way_by_peak)
mart_report("q3_right_of_way_matrix", f"""SELECT CASE WHEN is_dedicated_right_of_way THEN 'Dedicated Right-of-Way' ELSE 'Mixed General Traffic' END AS right_of_way,
 CASE WHEN is_peak_hour = 1 THEN 'Rush Hour (Peak)' ELSE 'Off-Peak' END AS traffic_period, count(*) AS observations, {MINUTES},
 round(avg(delta_t_run),2) AS mean_segment_run_s FROM mart WHERE {OPERATIONAL} GROUP BY 1, 2""", reports.right_of_way_matrix)
mart_report("q7_delay_quantiles", f"""SELECT count(*) AS total_records, round(avg({D}/60.0::DOUBLE),2) AS mean_min, round(stddev({D}/60.0::DOUBLE),2) AS std_min,
 {", ".join(f"round(quantile_cont({D}/60.0::DOUBLE, {q}),2) AS {n}" for n, q in reports.QUANTILES.items())} FROM mart WHERE {OPERATIONAL}""",
            reports.delay_quantiles)
mart_report("q8_cohort_punctuality", f"""SELECT transit_cohort, count(*) AS obs_count, round(100.0::DOUBLE*count(*)/sum(count(*)) OVER (),1) AS pct_share, {MINUTES},
 round(quantile_cont({D}/60.0::DOUBLE,0.9),2) AS p90_delay_min, round(avg(CASE WHEN {D} <= 180 THEN 1.0 ELSE 0.0 END)*100,1) AS pct_punctual_3min,
 round(avg(CASE WHEN {D} > 300 THEN 1.0 ELSE 0.0 END)*100,1) AS pct_late_5min, round(avg(segment_length_meters),1) AS mean_segment_m, {ROW_SHARE}
 FROM mart WHERE {OPERATIONAL} GROUP BY 1""", reports.cohort_punctuality)
mart_report("q9_delay_persistence", f"""SELECT transit_cohort, count(*) AS observations, round(corr(prev_stop_delay, {D}),4) AS lag1_correlation,
 round(corr(prev2_stop_delay, {D}),4) AS lag2_correlation, round(regr_slope({D}, prev_stop_delay),4) AS persistence_slope_rho,
 round(regr_r2({D}, prev_stop_delay),4) AS lag1_r_squared FROM mart WHERE {OPERATIONAL} AND abs(prev_stop_delay) <= 1800 GROUP BY 1""",
            reports.delay_persistence)
mart_report("q10_delay_by_progress", f"""SELECT transit_cohort, round(trip_progress,1) AS progress_decile, count(*) AS "count", {MINUTES}
 FROM mart WHERE {OPERATIONAL} AND {COHORTS} GROUP BY 1, 2""", reports.delay_by_progress)
mart_report("q11_weather_by_cohort", f"""SELECT transit_cohort, CASE WHEN is_raining = 1 THEN 'Active Rain' ELSE 'Dry Conditions' END AS weather_condition,
 count(*) AS observations, {MINUTES}, round(avg(delta_t_run),2) AS mean_run_delay_s FROM mart WHERE {OPERATIONAL} AND {COHORTS} GROUP BY 1, 2""",
            reports.weather_by_cohort)
mart_report("q11_rain_tiers", f"""SELECT CASE rain_intensity_category WHEN 0 THEN '0: None (Dry)' WHEN 1 THEN '1: Light (<= 0.5 mm)'
 WHEN 2 THEN '2: Moderate (0.5-2.0 mm)' WHEN 3 THEN '3: Heavy (> 2.0 mm)' END AS rain_tier, count(*) AS record_count,
 round(avg(precipitation_mm),2) AS avg_precip_mm, {MINUTES}, round(avg(delta_t_run),2) AS mean_delta_run_s FROM mart WHERE {OPERATIONAL} GROUP BY 1""",
            reports.rain_tiers)
mart_report("q11_temperature_curve", f"""SELECT round(temperature_c) AS temp_c, count(*) AS "count", {MINUTES} FROM mart WHERE {OPERATIONAL}
 GROUP BY 1""", reports.temperature_curve)
mart_report("q12_corridor_league", f"""SELECT corridor_name, count(*) AS observations, {MINUTES}, round(avg(delta_t_run),2) AS mean_delta_run_s,
 round(avg(signalized_intersection_count),1) AS avg_signals_per_link, round(avg(segment_length_meters),1) AS avg_stop_spacing_m, {ROW_SHARE}
 FROM mart WHERE corridor_name IS NOT NULL AND {OPERATIONAL} GROUP BY 1""", reports.corridor_league)
mart_report("q13_metro_adjacency", f"""SELECT CASE WHEN is_metro_proximity = 1 THEN 'Metro Adjacent (<= 300m)' ELSE 'Standard Surface Stop' END AS metro_status,
 count(*) AS observations, round(avg(dwell_seconds),1) AS mean_dwell_s, round(median(dwell_seconds),1) AS median_dwell_s,
 round(avg({D}/60.0::DOUBLE),2) AS mean_delay_min, round(avg(interchange_line_count),1) AS mean_routes_served FROM mart WHERE {OPERATIONAL} GROUP BY 1""",
            reports.metro_adjacency)
mart_report("q13_headway_regimes", f"""SELECT CASE WHEN headway_deviation < -0.2 THEN 'Bunched (< -20% Headway)' WHEN headway_deviation <= 0.2 THEN 'Regular (±20% Headway)'
 ELSE 'Gapped (> +20% Headway)' END AS headway_regime, count(*) AS observations, {MINUTES}, round(avg(delta_t_run),2) AS mean_delta_run_s
 FROM mart WHERE {OPERATIONAL} AND headway_deviation IS NOT NULL GROUP BY 1""", reports.headway_regimes)
mart_report("q14_forecast_accuracy", f"""SELECT confidence AS confidence_tier, count(*) AS record_count, round(avg({D}),1) AS obs_delay_mean_s,
 round(avg(zbk_forecast_delay_s),1) AS forecast_delay_mean_s, round(avg(forecast_error_s),1) AS mean_error_bias_s,
 round(avg(abs(forecast_error_s)),1) AS mae_seconds, round(sqrt(avg(forecast_error_s*forecast_error_s)),1) AS rmse_seconds,
 round(corr({D}, zbk_forecast_delay_s),3) AS pearson_correlation FROM mart WHERE forecast_error_s IS NOT NULL GROUP BY 1""",
            reports.forecast_accuracy)
mart_report("q17_rain_disparity", f"""SELECT transit_cohort, is_raining, count(*) AS total_observations, round(avg({D}),1) AS mean_delay_seconds,
 round(median({D}),1) AS median_delay_seconds, {ROW_SHARE} FROM mart GROUP BY 1, 2""", reports.rain_disparity)
_F = reports.CORRELATED
mart_report("q18_feature_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, " + ", ".join(
        (f"1.0::DOUBLE AS {b}" if a == b else f"round(corr({a}::DOUBLE, {b}::DOUBLE),3) + 0.0 AS {b}") for b in _F)
    + f" FROM mart WHERE {OPERATIONAL} AND abs(prev_stop_delay) <= 1800 AND headway_deviation IS NOT NULL" for a in _F),
            reports.feature_correlation)
SUMMARY = f"""SELECT count(*) AS total_observations, count(DISTINCT trip_id) AS distinct_trips, count(DISTINCT route_id) AS distinct_routes,
 sum(is_study_corridor)::BIGINT AS study_corridor_observations, round(avg(delta_t_run),2) AS avg_delta_t_run, round(median(delta_t_run),2) AS median_delta_t_run,
 round(stddev(delta_t_run),2) AS std_delta_t_run, round(avg(segment_length_meters),1) AS avg_segment_meters,
 round(avg(signalized_intersection_count),2) AS avg_signals, round(avg(temperature_c),1) AS avg_temperature_c,
 round(sum(CASE WHEN is_peak_hour = 1 THEN 1 ELSE 0 END)*100.0::DOUBLE/count(*),1) AS peak_hour_pct,
 round(sum(CASE WHEN is_tram = 1 THEN 1 ELSE 0 END)*100.0::DOUBLE/count(*),1) AS tram_share_pct, round(avg(dwell_seconds),2) AS avg_dwell_s FROM mart"""
mart_report("a9_mart_summary", SUMMARY, mart.mart_summary)
mart_report("a9_mart_by_corridor", """SELECT COALESCE(corridor_name,'non_study_network') AS corridor, count(*) AS obs, round(avg(delta_t_run),2) AS avg_delta_t_run,
 round(avg(segment_length_meters),1) AS avg_length_m, round(avg(signalized_intersection_count),2) AS avg_signals FROM mart GROUP BY 1""", mart.mart_by_corridor)
mart_report("a8_conditional_shares", """SELECT transit_cohort, round(sum(CASE WHEN is_peak_hour = 1 THEN 1 ELSE 0 END)*100.0::DOUBLE/count(*),1) AS peak_pct,
 round(sum(CASE WHEN is_raining = 1 THEN 1 ELSE 0 END)*100.0::DOUBLE/count(*),1) AS rain_pct FROM mart GROUP BY 1""",
            lambda m: m.groupBy("transit_cohort").agg(
                reports.rnd(F.count_if(F.col("is_peak_hour") == 1) * 100.0 / F.count(F.lit(1)), 1).alias("peak_pct"),
                reports.rnd(F.count_if(F.col("is_raining") == 1) * 100.0 / F.count(F.lit(1)), 1).alias("rain_pct")))

_INV = f"""SELECT '{{0}}' AS dataset_track, count(*) AS total_records, count(DISTINCT route_id) AS distinct_routes, count(DISTINCT trip_id) AS distinct_trips,
 count(DISTINCT stop_id) AS distinct_stops, strftime(min(arrival_ts),'%Y-%m-%d %H:%M:%S') AS earliest_arrival, strftime(max(arrival_ts),'%Y-%m-%d %H:%M:%S') AS latest_arrival,
 round(avg({D}),1) AS mean_delay_s, round(median({D}),1) AS median_delay_s, round(stddev({D}),1) AS std_delay_s FROM {{1}}"""
_TRACKS = ("Track B: Observed Ground Truth (Primary)", "Track A: GTFS-RT Baseline (Reference)")
_rename = [("legacy_mart" if n == "mart" else n, s) for n, s in LEGACY_STEPS]
_seen = {n for n, _ in OBSERVED_MART_STEPS}


@query("q6_track_inventory", with_views(
    [*OBSERVED_VIEWS, *LEGACY_VIEWS], _INV.format(_TRACKS[0], "mart") + " UNION ALL " + _INV.format(_TRACKS[1], "legacy_mart"),
    [*OBSERVED_MART_STEPS, *[(n, s) for n, s in _rename if n not in _seen]]))
def track_inventory(spark, sf):
    """Both marts as views: of their columns the inventory needs five, and none of a headway."""
    return comparable(reports.track_inventory({_TRACKS[0]: observed(spark, sf), _TRACKS[1]: legacy(spark, sf, deviation=False)}))


def _by_ingestion_day(updates):
    at = F.to_date(clock.epoch_to_utc("feed_timestamp"))
    return updates.withColumns({"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)})


view_report("q1_daily_ingestion", ["stop_updates"], f"""SELECT year(t) AS year, month(t) AS month, day(t) AS day, count(*) AS records_ingested,
 count(DISTINCT route_id) AS distinct_routes, count(DISTINCT vehicle_id) AS active_vehicles, round(avg({D}),1) AS mean_delay_s
 FROM (SELECT *, TIMESTAMP '1970-01-01' + to_seconds(feed_timestamp) AS t FROM stop_updates) GROUP BY 1, 2, 3""",
            lambda s, sf: reports.daily_ingestion(_by_ingestion_day(domain.stop_updates(s, sf))))
view_report("q4_weather_by_station", ["weather"], """SELECT station_name, count(*) AS total_hours, min("timestamp")::VARCHAR AS earliest_record,
 max("timestamp")::VARCHAR AS latest_record, round(avg(temperature_c),1) AS avg_temperature_c, round(sum(precipitation_mm),1) AS total_rainfall_mm
 FROM weather GROUP BY 1""", lambda s, sf: reports.weather_by_station(domain.weather(s, sf)))
view_report("q5_trip_observations", ["stop_updates"], """SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, stop_id, feed_timestamp, arrival_delay_seconds::BIGINT AS arrival_delay_seconds
 FROM stop_updates WHERE trip_id = 'T42'""",
            lambda s, sf: reports.one_trip(domain.stop_updates(s, sf), "T42").select("trip_id", "stop_sequence", "stop_id", "feed_timestamp", D))
view_report("q15_corridor_infrastructure", ["road_links"], """SELECT corridor_name, count(*) AS segment_count, round(sum(segment_length_meters)/1000.0::DOUBLE,2) AS corridor_km,
 round(avg(segment_length_meters),1) AS mean_stop_spacing_m, sum(signalized_intersection_count)::BIGINT AS total_signals,
 round(sum(signalized_intersection_count)/(sum(segment_length_meters)/1000.0::DOUBLE),2) AS signals_per_km, round(avg(lane_capacity),1) AS avg_lanes,
 round(100.0::DOUBLE*sum(CASE WHEN is_dedicated_right_of_way THEN 1 ELSE 0 END)/count(*),1) AS dedicated_row_pct FROM road_links WHERE corridor_name IS NOT NULL GROUP BY 1""",
            lambda s, sf: reports.corridor_infrastructure(domain.road_links(s, sf)))
view_report("a12_link_summary", ["road_links"], """SELECT count(*) AS total_segments, count(DISTINCT corridor_name) AS total_corridors,
 round(sum(segment_length_meters)/1000.0::DOUBLE,2) AS total_network_km, round(avg(segment_length_meters),1) AS avg_segment_meters,
 round(min(segment_length_meters),1) AS min_segment_meters, round(max(segment_length_meters),1) AS max_segment_meters,
 round(avg(signalized_intersection_count),2) AS avg_signals_per_segment, sum(signalized_intersection_count)::BIGINT AS total_signals_detected,
 sum(CASE WHEN is_dedicated_right_of_way THEN 1 ELSE 0 END)::BIGINT AS dedicated_row_segments, round(avg(lane_capacity),2) AS avg_lane_capacity,
 round(avg(tortuosity_ratio),3) AS avg_tortuosity FROM road_links""", lambda s, sf: reports.link_summary(domain.road_links(s, sf)))
view_report("a12_link_summary_by_corridor", ["road_links"], """SELECT COALESCE(corridor_name,'network_general') AS corridor_name, count(*) AS segments,
 round(sum(segment_length_meters)/1000.0::DOUBLE,2) AS length_km, round(avg(signalized_intersection_count),1) AS avg_signals FROM road_links GROUP BY 1""",
            lambda s, sf: reports.link_summary_by_corridor(domain.road_links(s, sf)))
view_report("q16_weather_range", ["weather"], """SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS at, station_id, temperature_c, relative_humidity, precipitation_mm, wind_speed_ms, freezing_rain_flag
 FROM weather WHERE "timestamp" >= TIMESTAMP '2026-10-14'""",
            lambda s, sf: reports.weather_range(domain.weather(s, sf), "2026-10-14").select(
                F.substring(F.col("timestamp").cast("string"), 1, 19).alias("at"), "station_id", "temperature_c", "relative_humidity",
                "precipitation_mm", "wind_speed_ms", "freezing_rain_flag"))
view_report("a11_weather_summary", ["weather"], """SELECT count(*) AS total_records, min("timestamp")::VARCHAR AS earliest_timestamp, max("timestamp")::VARCHAR AS latest_timestamp,
 round(avg(temperature_c),2) AS avg_temperature, round(min(temperature_c),2) AS min_temperature, round(max(temperature_c),2) AS max_temperature,
 round(avg(precipitation_mm),2) AS avg_precipitation, round(max(precipitation_mm),2) AS max_precipitation, count(DISTINCT station_name) AS active_stations FROM weather""",
            lambda s, sf: reports.weather_summary(domain.weather(s, sf)))
view_report("q17_daily_stop_events", ["stop_events"], f"""SELECT service_date AS date, count(*) AS stop_events, count(DISTINCT trip_id) AS complete_trips,
 count(DISTINCT route_id) AS routes_served, round(avg({D}),1) AS mean_delay_seconds,
 round(avg(CASE WHEN event_type = 'STOPPED' THEN 1.0 ELSE 0.0 END)*100,2) AS pct_interpolated FROM stop_events GROUP BY 1""",
            lambda s, sf: reports.daily_stop_events(domain.stop_events(s, sf)))
view_report("a13_catalog_stats", ["stop_updates"], f"""SELECT count(*) AS total_rows, count(DISTINCT trip_id) AS distinct_trips, count(DISTINCT route_id) AS distinct_routes,
 min({D})::BIGINT AS min_delay_sec, max({D})::BIGINT AS max_delay_sec, round(avg({D}),6) AS avg_delay_sec FROM stop_updates""",
            lambda s, sf: reports.catalog_stats(domain.stop_updates(s, sf)))
query("a13_file_stats")(lambda spark, sf: reports.file_stats(domain.table(spark, sf, "lineitem")))
view_report("a25_feed_stats", ["stop_updates"], """SELECT feed_timestamp, count(DISTINCT trip_id) AS total_trip_updates, count(*) AS total_stop_records,
 count(arrival_delay_seconds) AS records_with_delay, count(DISTINCT vehicle_id) AS active_vehicles, count(DISTINCT route_id) AS active_routes FROM stop_updates GROUP BY 1""",
            lambda s, sf: reports.feed_stats(domain.stop_updates(s, sf)))
view_report("j23_link_weather_preview", ["stop_updates", "road_links", "weather"], """SELECT * FROM (SELECT trip_id, route_id, stop_id, arrival_delay_seconds::BIGINT AS delay_s, strftime(utc_at,'%Y-%m-%d %H:%M:%S') AS arrival_time,
  temperature_c, precipitation_mm, corridor_name, segment_length_meters, signalized_intersection_count AS signals, is_dedicated_right_of_way AS dedicated_row
  FROM (SELECT *, TIMESTAMP '1970-01-01' + to_seconds(rt_arrival_time) AS utc_at FROM stop_updates WHERE abs(arrival_delay_seconds) <= 1800) t
  JOIN road_links osm ON t.stop_id = osm.stop_id_curr LEFT JOIN (SELECT date_trunc('hour', "timestamp") AS h, avg(temperature_c) AS temperature_c, max(precipitation_mm) AS precipitation_mm FROM weather GROUP BY 1) w ON date_trunc('hour', utc_at) = w.h)
 ORDER BY trip_id, route_id, stop_id, delay_s, arrival_time, temperature_c NULLS FIRST, precipitation_mm NULLS FIRST, corridor_name NULLS FIRST, segment_length_meters, signals, dedicated_row LIMIT 10""",
            lambda s, sf: reports.link_weather_preview(
                domain.stop_updates(s, sf), domain.road_links(s, sf), hourly_rollup(domain.weather(s, sf))))


_DAYS = [("days", " UNION ALL ".join(f"SELECT '{n}' AS source, {d} AS day, count(*) AS n FROM {v} WHERE {d} IS NOT NULL GROUP BY 2" for n, d, v in (
    ("updates", "DATE '1970-01-01' + floor(feed_timestamp/86400)::INTEGER", "stop_updates"), ("events", "DATE '1970-01-01' + floor(actual_arrival_utc/86400)::INTEGER", "stop_events"),
    ("fixes", "DATE '1970-01-01' + floor(gps_timestamp_utc/86400)::INTEGER", "vehicle_fixes"), ("weather", '"timestamp"::DATE', "weather"), ("mart", "arrival_ts::DATE", "mart")))),
    ("ends", """SELECT d.source, d.day AS first_day, (SELECT min(e.day) FROM days e WHERE e.source = d.source AND e.day >= d.day AND NOT EXISTS (SELECT 1 FROM days f WHERE f.source = e.source AND f.day = e.day + 1)) AS last_day
      FROM days d WHERE NOT EXISTS (SELECT 1 FROM days f WHERE f.source = d.source AND f.day = d.day - 1)"""),
    ("full_days", "SELECT day FROM days GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT source) FROM days)"),
    ("full_runs", """SELECT d.day AS a, (SELECT min(e.day) FROM full_days e WHERE e.day >= d.day AND e.day + 1 NOT IN (SELECT day FROM full_days)) AS b FROM full_days d WHERE d.day - 1 NOT IN (SELECT day FROM full_days)"""),
    ("best", "SELECT a, b FROM full_runs ORDER BY b - a DESC, a LIMIT 1"),
    ("bounds", "SELECT source, min(day) AS lo, max(day) AS hi, count(*) AS k, sum(n)::BIGINT AS n FROM days GROUP BY 1"),
    ("shared", "SELECT max(lo) AS lo, min(hi) AS hi FROM bounds")]


@query("a23_study_window", with_views([*OBSERVED_VIEWS, "stop_updates", "stop_events", "vehicle_fixes", "weather"], """SELECT source, x.lo::VARCHAR AS first_day, x.hi::VARCHAR AS last_day, k AS n_days, (SELECT count(*) FROM ends WHERE ends.source = x.source) AS n_spans,
 n AS rows, (x.hi - x.lo + 1 - k)::BIGINT AS missing_days, greatest(0, (SELECT hi FROM bounds WHERE source = 'updates') - x.hi)::BIGINT AS lag_days, shared.lo::VARCHAR AS common_start, shared.hi::VARCHAR AS common_end, shared.lo <= shared.hi AS is_ready,
 CASE WHEN shared.lo <= shared.hi THEN (SELECT a FROM best) END::VARCHAR AS recommended_start, CASE WHEN shared.lo <= shared.hi THEN (SELECT b FROM best) END::VARCHAR AS recommended_end FROM bounds x, shared""", [*OBSERVED_MART_STEPS, *_DAYS]))
def study_window(spark, sf):
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(c) / 86400).cast("int"))
    days = reports.source_days({
        "updates": (domain.stop_updates(spark, sf), day("feed_timestamp")), "events": (domain.stop_events(spark, sf), day("actual_arrival_utc")), "fixes": (domain.vehicle_fixes(spark, sf), day("gps_timestamp_utc")),
        "weather": (domain.weather(spark, sf), F.to_date("timestamp")), "mart": (stored_observed(spark, sf), F.to_date("arrival_ts"))})
    return comparable(reports.study_window(days, "updates"))
