"""Registered queries: samples, splits and their audit over the stored observed mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import positions, sampling, split
from fleetlens.plans.queries_mart import observed_oracle
from fleetlens.plans.queries_reports import stored_observed
from fleetlens.plans.registry import comparable, query

SIZE = 20000
QUOTA = sampling.quota_per_stratum(SIZE)

_INSTANCE = "concat(trip_id, '_', arrival_ts::DATE)"
# A stratum is one list of its trips in hash order: its head is the sample, the lengths of list and head are the two counts a weight needs.
SAMPLE_STEPS = [
    ("tm", f"""SELECT {_INSTANCE} AS trip_instance, first(arrival_ts::DATE)::VARCHAR AS service_day,
      ['dry', 'light_rain', 'mod_heavy_rain'][1 + bool_or(coalesce(precipitation_mm, 0) > 0)::INT + bool_or(coalesce(precipitation_mm, 0) > 1)::INT] AS regime_weather,
      ['bus_mixed_traffic', 'bus_dedicated_row', 'tram_row'][greatest(1, 2*count_if(is_dedicated_right_of_way).sign(), 3*count_if(is_tram = 1 OR transit_cohort = 'urban_tram').sign())] AS regime_infra,
      ['offpeak', 'peak'][1 + count_if(is_peak_hour = 1).sign()] AS regime_time, count(*) AS n_stops FROM mart GROUP BY trip_instance"""),
    ("strata", "SELECT service_day, list_sort(list({'h': md5(trip_instance || '_42'), 'trip': trip_instance})) AS members FROM tm GROUP BY service_day, regime_weather, regime_infra, regime_time"),
    ("share", f"SELECT greatest(1, ceil({QUOTA} / count(DISTINCT service_day)))::BIGINT AS q FROM strata"),
    ("heads", "SELECT service_day, len(members) AS there, members[1:q] AS head FROM strata, share"),
    ("days", "SELECT service_day, sum(there) AS there_day, sum(len(head)) AS head_day FROM heads GROUP BY service_day"),
    ("weighted", """SELECT unnest(list_transform(head, lambda m: m.trip)) AS trip_instance, round((there / there_day::DOUBLE) / (len(head) / head_day::DOUBLE), 6) AS inverse_sampling_weight
      FROM heads JOIN days USING (service_day)"""),
    ("smp_rows", f"SELECT mart.*, inverse_sampling_weight AS w0 FROM mart JOIN weighted ON trip_instance = {_INSTANCE}"),
]


@query("a5_trip_regimes", observed_oracle("SELECT * FROM tm", SAMPLE_STEPS[:1]))
def regimes(spark, sf):
    return sampling.trip_regimes(stored_observed(spark, sf))


@query("w10_w11_sampled_trips", observed_oracle("SELECT trip_instance, inverse_sampling_weight FROM weighted", SAMPLE_STEPS))
def sampled(spark, sf):
    return comparable(sampling.sampled_trips(sampling.trip_regimes(stored_observed(spark, sf)), QUOTA))


@query("t5_stratified_sample", observed_oracle("""SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, strftime(arrival_ts, '%Y-%m-%d %H:%M:%S') AS arrival_ts,
  round(w0/(SELECT avg(w0) FROM smp_rows), 6) AS inverse_sampling_weight FROM smp_rows""", SAMPLE_STEPS))
def stratified(spark, sf):
    s = sampling.stratified_sample(stored_observed(spark, sf), SIZE)
    return comparable(s.select("trip_id", "stop_sequence", "arrival_ts", sampling.WEIGHT))


@query("t4_uniform_sample", observed_oracle("""SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, 1.0::DOUBLE AS inverse_sampling_weight FROM mart
  ORDER BY md5(trip_id||'/'||stop_sequence::VARCHAR||'/'||strftime(arrival_ts, '%Y-%m-%d %H:%M:%S')||'_42') LIMIT 500"""))
def uniform(spark, sf):
    m = stored_observed(spark, sf)
    key = F.concat_ws("/", "trip_id", F.col("stop_sequence").cast("string"), F.substring(F.col("arrival_ts").cast("string"), 1, 19))
    return comparable(sampling.uniform_sample(m, 500, 42, key).select("trip_id", "stop_sequence", sampling.WEIGHT))


@query("t6_full_load", observed_oracle("SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, delta_t_run, 1.0::DOUBLE AS inverse_sampling_weight FROM mart"))
def full_load(spark, sf):
    return comparable(sampling.load_sample(stored_observed(spark, sf), 0).select("trip_id", "stop_sequence", "delta_t_run", sampling.WEIGHT))


@query("t8_row_positions", observed_oracle("""SELECT pos, at_value FROM (SELECT row_number() OVER (ORDER BY epoch(arrival_ts)) - 1 AS pos, epoch(arrival_ts)::BIGINT AS at_value, count(*) OVER () AS n FROM mart)
  WHERE pos IN (floor(n*0.25), floor(n*0.5), floor(n*0.75))"""))
def row_positions(spark, sf):
    m = stored_observed(spark, sf)
    t = split.micros("arrival_ts")
    n = m.count()
    wanted = [int(n * p) for p in (0.25, 0.5, 0.75)]
    values = positions.values_at(m, t, wanted, n)
    rows = F.array(*[F.struct(F.lit(p).cast("long").alias("pos"), F.lit(v // split.US).cast("long").alias("at_value")) for p, v in zip(wanted, values)])
    return m.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


SPLIT_STEPS = [
    ("timeline", "SELECT *, row_number() OVER (ORDER BY arrival_ts) - 1 AS pos, count(*) OVER () AS n FROM mart"),
    ("cut", """SELECT t1, t1 + INTERVAL 30 MINUTE AS v0, t2, t2 + INTERVAL 30 MINUTE AS s0 FROM (SELECT
       max(arrival_ts) FILTER (pos = floor(n*0.6)) AS t1, max(arrival_ts) FILTER (pos = floor(n*0.8)) AS t2 FROM timeline)"""),
    ("x1", """SELECT trip_id FROM mart, cut WHERE arrival_ts BETWEEN t1 - INTERVAL 4 HOUR AND v0 + INTERVAL 4 HOUR GROUP BY trip_id, t1, v0
       HAVING (min(arrival_ts) <= t1 AND max(arrival_ts) > t1) OR (max(arrival_ts) >= t1 AND min(arrival_ts) <= v0)"""),
    ("x2", """SELECT trip_id FROM mart, cut WHERE arrival_ts BETWEEN t2 - INTERVAL 4 HOUR AND s0 + INTERVAL 4 HOUR GROUP BY trip_id, t2, s0
       HAVING (min(arrival_ts) <= t2 AND max(arrival_ts) > t2) OR (max(arrival_ts) >= t2 AND min(arrival_ts) <= s0)"""),
    ("r1", """SELECT vehicle_id FROM mart, cut WHERE arrival_ts BETWEEN t1 - INTERVAL 45 MINUTE AND t1 INTERSECT SELECT vehicle_id FROM mart, cut WHERE arrival_ts BETWEEN v0 AND v0 + INTERVAL 45 MINUTE"""),
    ("r2", """SELECT vehicle_id FROM mart, cut WHERE arrival_ts BETWEEN t2 - INTERVAL 45 MINUTE AND t2 INTERSECT SELECT vehicle_id FROM mart, cut WHERE arrival_ts BETWEEN s0 AND s0 + INTERVAL 45 MINUTE"""),
    ("flags", """SELECT m.*, arrival_ts BETWEEN t1 - INTERVAL 4 HOUR AND v0 + INTERVAL 4 HOUR AND trip_id IN (FROM x1) AS p1,
       arrival_ts BETWEEN t2 - INTERVAL 4 HOUR AND s0 + INTERVAL 4 HOUR AND trip_id IN (FROM x2) AS p2,
       vehicle_id IN (FROM r1) AND arrival_ts <= v0 + INTERVAL 45 MINUTE AS q1, vehicle_id IN (FROM r2) AND arrival_ts <= s0 + INTERVAL 45 MINUTE AS q2, t1, v0, t2, s0 FROM mart m, cut"""),
    ("labelled", """SELECT * FROM (SELECT *, CASE WHEN arrival_ts <= t1 AND NOT p1 THEN 'train' WHEN arrival_ts BETWEEN v0 AND t2 AND NOT p1 AND NOT p2 AND NOT q1 THEN 'val'
       WHEN arrival_ts >= s0 AND NOT p2 AND NOT q2 THEN 'test' END AS split FROM flags) WHERE split IS NOT NULL"""),
]
_LABELS = "SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, strftime(arrival_ts, '%Y-%m-%d %H:%M:%S') AS arrival_ts, split FROM "


def labelled(spark, sf, **options):
    m = stored_observed(spark, sf)
    return split.purged_split(m, split.find_cuts(m, "arrival_ts"), **options)


@query("c8_purged_split", observed_oracle(_LABELS + "labelled", SPLIT_STEPS))
def purged_split(spark, sf):
    return comparable(labelled(spark, sf).select("trip_id", "stop_sequence", "arrival_ts", "split"))


@query("c8_strict_split", observed_oracle(_LABELS + """labelled l WHERE split = 'train' OR (split = 'val' AND trip_id NOT IN (SELECT trip_id FROM labelled WHERE split = 'train'))
  OR (split = 'test' AND trip_id NOT IN (SELECT trip_id FROM labelled WHERE split IN ('train', 'val')))""", SPLIT_STEPS))
def strict_split(spark, sf):
    return comparable(labelled(spark, sf, strict_trips=True).select("trip_id", "stop_sequence", "arrival_ts", "split"))


@query("c10_leakage_audit", observed_oracle("""SELECT count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows, count(*) FILTER (split = 'test') AS test_rows,
  epoch(min(arrival_ts) FILTER (split = 'val') - max(arrival_ts) FILTER (split = 'train'))::BIGINT AS gap_train_val_s, epoch(min(arrival_ts) FILTER (split = 'test') - max(arrival_ts) FILTER (split = 'val'))::BIGINT AS gap_val_test_s,
  0::BIGINT AS boundary_overlap, true AS is_leakage_free FROM labelled""", SPLIT_STEPS))
def leakage_audit(spark, sf):
    r = split.audit(labelled(spark, sf), 30.0, raise_on_error=False)
    return spark.range(1).select(
        *[F.lit(r[f"{b}_rows"]).cast("long").alias(f"{b}_rows") for b in ("train", "val", "test")],
        F.lit(r["embargo_gap_train_val_seconds"]).cast("long").alias("gap_train_val_s"),
        F.lit(r["embargo_gap_val_test_seconds"]).cast("long").alias("gap_val_test_s"),
        F.lit(r["boundary_crossing_overlap_count"]).cast("long").alias("boundary_overlap"),
        F.lit(r["is_leakage_free"]).alias("is_leakage_free"))


FOLD_STEPS = [("timeline", SPLIT_STEPS[0][1])]
for _f, (_a, _b) in enumerate(((0.5, 0.65), (0.675, 0.825), (0.85, 1.0))):
    FOLD_STEPS += [
        (f"fc{_f}", f"""SELECT t1, t1 + INTERVAL 30 MINUTE AS v0, t2 FROM (SELECT max(arrival_ts) FILTER (pos = floor(n*{_a}::DOUBLE)) AS t1,
           max(arrival_ts) FILTER (pos = least(floor(n*{_b}::DOUBLE), n - 1)) AS t2 FROM timeline)"""),
        (f"fx{_f}", f"""SELECT trip_id FROM mart, fc{_f} WHERE arrival_ts BETWEEN t1 - INTERVAL 4 HOUR AND v0 + INTERVAL 4 HOUR GROUP BY trip_id, t1, v0
           HAVING (min(arrival_ts) <= t1 AND max(arrival_ts) > t1) OR (max(arrival_ts) >= t1 AND min(arrival_ts) <= v0)"""),
        (f"fold{_f}", f"""SELECT {_f} AS fold, trip_id, stop_sequence, arrival_ts, CASE WHEN arrival_ts <= t1 THEN 'train' ELSE 'val' END AS split FROM mart, fc{_f}
           WHERE t2 > v0 AND (arrival_ts <= t1 OR arrival_ts BETWEEN v0 AND t2)
            AND NOT (arrival_ts BETWEEN t1 - INTERVAL 4 HOUR AND v0 + INTERVAL 4 HOUR AND trip_id IN (FROM fx{_f}))"""),
    ]


@query("c9_walk_forward_folds", observed_oracle("""SELECT fold::BIGINT AS fold, split, count(*) AS n, count(DISTINCT trip_id) AS trips, strftime(max(arrival_ts), '%Y-%m-%d %H:%M:%S') AS last_arrival
  FROM (FROM fold0 UNION ALL FROM fold1 UNION ALL FROM fold2) GROUP BY 1, 2""", FOLD_STEPS))
def walk_forward(spark, sf):
    folds = split.walk_forward(stored_observed(spark, sf))
    rows = folds[0]
    for f in folds[1:]:
        rows = rows.unionByName(f)
    return comparable(rows.groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("trip_id").alias("trips"), F.max("arrival_ts").alias("last_arrival")))
