"""Registered queries: metrics, panel regression, trees and explanations over the stored mart.

Explanations are checked with a fixed scoring formula, which SQL can repeat; fitted models are
checked by unit tests and run here for their rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.models import boosting, explain, metrics, panel
from fleetlens.models.features import BENCHMARK

from fleetlens.plans.queries_mart import observed_oracle
from fleetlens.plans.queries_reports import stored_observed
from fleetlens.plans.queries_sampling import SPLIT_STEPS, labelled
from fleetlens.plans.registry import comparable, query

def formula(df):
    """Scoring formula with one interaction, so that explanations have something to find."""
    v = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in
         ("prev_stop_delay", "signalized_intersection_count", "segment_length_meters", "headway_deviation", "is_dedicated_right_of_way", "is_tram")}
    prev, sig, seg, gap, lane, tram = v.values()
    score = 4.0 + 0.03 * prev + 2.5 * sig + 0.004 * seg + 0.02 * gap - 6.0 * lane - 3.0 * tram + 0.01 * prev * (1.0 - lane)
    return df.withColumn("prediction", score)


def formula_sql(**over: str) -> str:
    v = dict(prev="COALESCE(prev_stop_delay, 0)::DOUBLE", sig="COALESCE(signalized_intersection_count, 0)::DOUBLE", seg="COALESCE(segment_length_meters, 0)::DOUBLE",
             gap="COALESCE(headway_deviation, 0)::DOUBLE", lane="is_dedicated_right_of_way::INTEGER::DOUBLE", tram="is_tram::DOUBLE")
    v.update(over)
    return "(4.0::DOUBLE + 0.03::DOUBLE*{prev} + 2.5::DOUBLE*{sig} + 0.004::DOUBLE*{seg} + 0.02::DOUBLE*{gap} - 6.0::DOUBLE*{lane} - 3.0::DOUBLE*{tram} + 0.01::DOUBLE*{prev}*(1.0::DOUBLE-{lane}))".format(**v)


SCORED = ("scored", f"SELECT *, {formula_sql()} AS p, delta_t_run AS y FROM mart")


@query("m1_regression_metrics", observed_oracle("""SELECT round_even(avg(abs(p-y)),4) AS mae, round_even(sqrt(avg(pow(p-y,2))),4) AS rmse,
 round_even(1 - sum(pow(p-y,2))/(var_pop(y)*count(*)),4) AS r2, round_even(sum(abs(p-y))/sum(abs(y))*100,4) AS wape, round_even(median(abs(p-y)),4) AS medae,
 round_even(max(abs(p-y)),4) AS max_error, round_even(corr(y,p),4) AS pearson_r FROM scored""", [SCORED]))
def regression_metrics(spark, sf):
    return comparable(metrics.regression_metrics(formula(stored_observed(spark, sf)), "delta_t_run", "prediction"))


@query("m2_regime_metrics", observed_oracle("""SELECT round_even(avg(abs(p-y)) FILTER (NOT precipitation_mm > 0),2) AS val_mae_dry, round_even(avg(abs(p-y)) FILTER (precipitation_mm > 0),2) AS val_mae_rain,
 round_even(avg(abs(p-y)) FILTER (is_peak_hour = 1),2) AS val_mae_peak, round_even(avg(abs(p-y)) FILTER (is_peak_hour != 1),2) AS val_mae_offpeak FROM scored""", [SCORED]))
def regime_metrics(spark, sf):
    return comparable(metrics.regime_metrics(formula(stored_observed(spark, sf)), "delta_t_run", "prediction"))


@query("m3_m6_panel_coefficients")
def panel_coefficients(spark, sf):
    fit = panel.fit(stored_observed(spark, sf), BENCHMARK)
    return panel.coefficient_table(fit, spark)


_R = "y - 2.5::DOUBLE*signalized_intersection_count - 0.004::DOUBLE*segment_length_meters"
EFFECTS = [("rr", f"SELECT route_id, hour_of_day, {_R} AS r FROM (SELECT *, delta_t_run AS y FROM mart)"), ("g", "SELECT avg(r) AS g FROM rr"),
    ("e0", "SELECT route_id, hour_of_day, r - g AS r FROM rr, g"), ("t0", "SELECT DISTINCT hour_of_day, 0.0::DOUBLE AS te FROM e0")]
for _i in range(1, 4):
    EFFECTS += [(f"en{_i}", f"SELECT route_id, avg(r - te) AS ee FROM e0 JOIN t{_i-1} USING (hour_of_day) GROUP BY 1"),
                (f"t{_i}", f"SELECT hour_of_day, avg(r - ee) AS te FROM e0 JOIN en{_i} USING (route_id) GROUP BY 1")]
FIXED = {"signalized_intersection_count": 2.5, "segment_length_meters": 0.004}


def fixed_effects(spark, sf):
    m = stored_observed(spark, sf)
    left = F.col("delta_t_run")
    for c, b in FIXED.items():
        left = left - F.col(c) * b
    grand, by_entity, by_time = panel.recover_effects(m.withColumns({"w": F.lit(1.0), "__r": left}), "__r", "route_id", "hour_of_day")
    return panel.PanelFit("delta_t_run", "route_id", "hour_of_day", list(FIXED), FIXED, grand, by_entity, by_time)


@query("m4_recovered_effects", observed_oracle("SELECT 'entity' AS kind, route_id AS level, round(ee, 5) + 0.0 AS effect FROM en3 UNION ALL SELECT 'time', hour_of_day::VARCHAR, round(te, 5) + 0.0 FROM t3", EFFECTS))
def recovered_effects(spark, sf):
    f = fixed_effects(spark, sf)
    e = f.entity_effects.select(F.lit("entity").alias("kind"), F.col("route_id").alias("level"), F.col("entity_effect").alias("effect"))
    t = f.time_effects.select(F.lit("time").alias("kind"), F.col("hour_of_day").cast("string").alias("level"), F.col("time_effect").alias("effect"))
    return comparable(e.unionByName(t), 5)


@query("m5_panel_predictions", observed_oracle("""SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, round(g + ee + te + 2.5::DOUBLE*signalized_intersection_count + 0.004::DOUBLE*segment_length_meters, 5) + 0.0 AS prediction
 FROM mart JOIN en3 USING (route_id) JOIN t3 USING (hour_of_day), g""", EFFECTS))
def panel_predictions(spark, sf):
    return comparable(fixed_effects(spark, sf).predict(stored_observed(spark, sf)).select("trip_id", "stop_sequence", "prediction"), 5)


@query("m7_winsorized", observed_oracle("""SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, round(greatest(lo, least(hi, COALESCE(headway_deviation, 0))), 6) + 0.0 AS headway_deviation,
  round(greatest(plo, least(phi, prev_stop_delay)), 6) + 0.0 AS prev_stop_delay FROM mart, (SELECT quantile_cont(COALESCE(headway_deviation, 0), 0.01) AS lo, quantile_cont(COALESCE(headway_deviation, 0), 0.99) AS hi FROM labelled WHERE split = 'train'),
  (SELECT v[1 + floor(a)::BIGINT] + (a - floor(a))*(v[least(2 + floor(a)::BIGINT, n)] - v[1 + floor(a)::BIGINT]) AS plo, v[1 + floor(b)::BIGINT] + (b - floor(b))*(v[least(2 + floor(b)::BIGINT, n)] - v[1 + floor(b)::BIGINT]) AS phi
   FROM (SELECT *, (n - 1)*0.0005::DOUBLE AS a, (n - 1)*0.9995::DOUBLE AS b FROM (SELECT list_sort(list(prev_stop_delay::DOUBLE)) AS v, count(*) AS n FROM labelled WHERE split = 'train')))""", SPLIT_STEPS))
def winsorized(spark, sf):
    train = labelled(spark, sf).filter("split = 'train'")
    cols = ["headway_deviation", "prev_stop_delay"]
    m = boosting.prepared(stored_observed(spark, sf), cols, boosting.winsor_bounds(train, cols))
    return comparable(m.select("trip_id", "stop_sequence", *cols))


def fitted_trees(spark, sf):
    rows = labelled(spark, sf)
    model = boosting.BoostedTrees()
    return model.fit(rows.filter("split = 'train'").drop("split"), rows.filter("split = 'val'").drop("split"), BENCHMARK), rows


@query("m8_boosted_trees")
def boosted_trees(spark, sf):
    model, rows = fitted_trees(spark, sf)
    return metrics.regression_metrics(model.predict(rows.filter("split = 'test'")), "delta_t_run", "prediction", "test_")


# The cohorts that the comparison reports.
COHORTS = ["urban_tram", "urban_bus", "suburban_bus"]


@query("m9_model_comparison", observed_oracle(" UNION ALL ".join(
    f"""SELECT '{m}' AS model, '{c}' AS cohort, round_even(avg(abs({p}-y)),4) AS mae, round_even(sqrt(avg(pow({p}-y,2))),4) AS rmse FROM scored WHERE {w}"""
    for m, p in (("formula", "p"), ("zero", "0.0::DOUBLE")) for c, w in (("all", "true"), *((c, f"transit_cohort = '{c}'") for c in COHORTS))), [SCORED]))
def model_comparison(spark, sf):
    m = stored_observed(spark, sf)
    table = metrics.comparison({"formula": formula(m), "zero": m.withColumn("prediction", F.lit(0.0))}, "delta_t_run", cohorts=COHORTS)
    return comparable(table.select("model", "cohort", "mae", "rmse"))


BOARD = ("board", "SELECT m, c, p, y FROM (SELECT 'formula' AS m, p, y, transit_cohort AS tc FROM scored UNION ALL SELECT 'previous', prev_stop_delay::DOUBLE, y, transit_cohort FROM scored) g, LATERAL (SELECT unnest(['all', tc]) AS c) WHERE p IS NOT NULL AND y IS NOT NULL")


@query("m9_scoreboard", observed_oracle(f"""SELECT m AS model, c AS cohort, count(*) AS rows, round_even(avg(abs(p-y)),4) AS mae, round_even(sqrt(avg(pow(p-y,2))),4) AS rmse, round_even(1 - sum(pow(p-y,2))/(var_pop(y)*count(*)),4) AS r2,
  round_even(sum(abs(p-y))/sum(abs(y))*100,4) AS wape, round_even(median(round(abs(p-y)*1000))/1000,4) AS medae, round_even(max(abs(p-y)),4) AS max_error, round_even(corr(y,p),4) AS pearson_r
  FROM board WHERE c IN ('all', {', '.join(repr(c) for c in COHORTS)}) GROUP BY 1, 2""", [SCORED, BOARD]))
def scoreboard(spark, sf):
    m = formula(stored_observed(spark, sf)).withColumn("previous", F.col("prev_stop_delay").cast("double"))
    return comparable(metrics.scoreboard(m, "delta_t_run", {"formula": "prediction", "previous": "previous"}, cohorts=COHORTS))


def benchmark_rows(spark, sf):
    """Test rows away from terminals with the predictions of the panel model and of the trees, both fitted on the train block."""
    rows = metrics.without_terminals(labelled(spark, sf))
    train, val, test = (rows.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test"))
    effects = panel.fit(train, BENCHMARK)
    trees = boosting.BoostedTrees().fit(train, val, BENCHMARK)
    return trees.predict(effects.predict(test, "panel")).withColumnRenamed("prediction", "trees").withColumn("zero", F.lit(0.0))


@query("m9_benchmark_run")
def benchmark_run(spark, sf):
    return metrics.scoreboard(benchmark_rows(spark, sf), "delta_t_run", {m: m for m in ("panel", "trees", "zero")}, cohorts=COHORTS)


ALE = [("vals", "SELECT *, segment_length_meters::DOUBLE AS v FROM mart"), ("tails", "SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM vals"),
    ("borders", f"SELECT row_number() OVER (ORDER BY g) - 1 AS k, g FROM (SELECT DISTINCT unnest(quantile_cont(greatest(a, least(b, v)), {[i / 10 for i in range(11)]})) AS g FROM vals, tails)"),
    ("bins", "SELECT a.k, a.g AS lo, b.g AS hi, b.k = (SELECT max(k) FROM borders) AS is_last FROM borders a JOIN borders b ON b.k = a.k + 1"),
    ("steps", f"""SELECT k, COALESCE(avg({formula_sql(seg='hi')} - {formula_sql(seg='lo')}), 0) AS d, count(v) AS n FROM bins LEFT JOIN vals ON v >= lo AND (v < hi OR (is_last AND v <= hi)) GROUP BY 1"""),
    ("curve", "SELECT b.k, g, COALESCE(sum(d), 0) AS ale FROM borders b LEFT JOIN steps s ON s.k < b.k GROUP BY 1, 2"),
    ("centre", """SELECT avg(CASE WHEN v <= (SELECT min(g) FROM borders) THEN 0 WHEN v >= (SELECT max(g) FROM borders) THEN (SELECT max_by(ale, k) FROM curve)
       ELSE c0.ale + (v - lo)/(hi - lo)*(c1.ale - c0.ale) END) AS c FROM vals LEFT JOIN bins ON v >= lo AND v < hi LEFT JOIN curve c0 ON c0.k = bins.k LEFT JOIN curve c1 ON c1.k = bins.k + 1""")]


@query("m10_ale_curve", observed_oracle("""SELECT round(g, 4) AS grid_val, round(ale, 4) + 0.0 AS ale, round(ale - c, 4) + 0.0 AS ale_centered, COALESCE(n, 0)::BIGINT AS bin_count FROM curve LEFT JOIN steps USING (k), centre""", ALE))
def ale_curve(spark, sf):
    m = stored_observed(spark, sf)
    curve = explain.ale_curve(m, formula, "segment_length_meters", explain.ale_grid(m, "segment_length_meters", 10))
    return comparable(curve.select("grid_val", "ale", "ale_centered", "bin_count"), 4)


def kinked(df):
    """A formula whose effect of the previous delay bends at 60 s."""
    late = F.coalesce(F.col("prev_stop_delay").cast("double"), F.lit(0.0))
    return df.withColumn("prediction", F.when(late > 60, (late - 60) * 0.5 + 6).otherwise(late * 0.1))


KINK = [("pts", "SELECT unnest([-60.0, 0.0, 30.0, 60.0, 90.0, 240.0, 600.0])::DOUBLE AS g"),
    ("eff", "SELECT g, CASE WHEN g > 60 THEN (g - 60)*0.5::DOUBLE + 6 ELSE g*0.1::DOUBLE END AS y FROM pts"),
    ("ranged", "SELECT a.g AS lo, b.g AS hi, b.y - a.y AS d FROM eff a JOIN eff b ON b.g = (SELECT min(g) FROM pts WHERE g > a.g)"),
    ("used", "SELECT lo, hi, CASE WHEN EXISTS (SELECT 1 FROM mart WHERE prev_stop_delay >= lo AND prev_stop_delay < hi) THEN d ELSE 0 END AS d FROM ranged"),
    ("acc", "SELECT hi AS g, d/(hi - lo) AS before, lead(d/(hi - lo)) OVER (ORDER BY hi) AS after FROM used")]


@query("m11_tipping_points", observed_oracle("""SELECT g AS threshold_value, round(before, 6) + 0.0 AS slope_before, round(after, 6) + 0.0 AS slope_after, round(after - before, 6) + 0.0 AS slope_change FROM acc WHERE abs(after - before) >= 0.05""", KINK))
def tipping(spark, sf):
    curve = explain.ale_curve(stored_observed(spark, sf), kinked, "prev_stop_delay", [-60.0, 0.0, 30.0, 60.0, 90.0, 240.0, 600.0])
    return comparable(explain.tipping_points(curve, "prev_stop_delay").drop("feature", "ale_effect_at_threshold"))


_B = [("q", "SELECT quantile_cont(prev_stop_delay::DOUBLE, 0.15) AS a, quantile_cont(prev_stop_delay::DOUBLE, 0.85) AS b FROM mart"),
    ("four", f"""SELECT a, b, avg({formula_sql(prev='a', lane='0', tram='0')}) AS mb, avg({formula_sql(prev='b', lane='0', tram='0')}) AS ms, avg({formula_sql(prev='a', lane='1')}) AS db, avg({formula_sql(prev='b', lane='1')}) AS ds FROM mart, q GROUP BY 1, 2""")]


@query("m12_buffering_effect", observed_oracle("""SELECT round_even(a,2) AS baseline_value, round_even(b,2) AS shock_value, round_even(ms,2) AS pred_mixed_shock_s, round_even(ds,2) AS pred_dedicated_shock_s,
 round_even(ms-ds,2) AS shock_regime_savings_s, round_even(ms-mb,2) AS delay_increase_mixed_traffic_s, round_even(ds-db,2) AS delay_increase_dedicated_row_s,
 round_even((ms-mb)-(ds-db),2) AS buffering_effect_seconds_saved, round_even(((ms-mb)-(ds-db))/(ms-mb)*100,1) AS buffering_mitigation_pct FROM four""", _B))
def buffering(spark, sf):
    return comparable(explain.buffering_effect(stored_observed(spark, sf), formula).drop("shock_feature", "infra_feature"))


@query("m13_response_curve", observed_oracle(f"""SELECT i::BIGINT AS point, round(x, 4) + 0.0 AS shock_value, round(avg({formula_sql(prev='x', lane='0', tram='0')}), 4) + 0.0 AS pred_mixed, round(avg({formula_sql(prev='x', lane='1')}), 4) + 0.0 AS pred_dedicated
 FROM mart, (SELECT i, lo + (hi - lo)*i/39.0::DOUBLE AS x FROM (SELECT quantile_cont(prev_stop_delay::DOUBLE, 0.02) AS lo, quantile_cont(prev_stop_delay::DOUBLE, 0.98) AS hi FROM mart), (SELECT unnest(range(40)) AS i)) GROUP BY 1, x"""))
def response(spark, sf):
    return comparable(explain.response_curve(stored_observed(spark, sf), formula), 4)


_HELD = "CASE WHEN prev_stop_delay > 0 THEN least(greatest(0.0, prev_stop_delay - 240.0), prev_stop_delay*0.35::DOUBLE) ELSE prev_stop_delay END::DOUBLE"
_SIG = "greatest(0.0, signalized_intersection_count - 2.0)::DOUBLE"
WHAT_IF = [("w0", f"SELECT *, {formula_sql()} AS base, {_HELD} AS held, CASE WHEN COALESCE(headway_deviation,0) > 0 THEN 0.0::DOUBLE ELSE COALESCE(headway_deviation,0) END AS even0 FROM src"),
    ("w1", f"SELECT *, {formula_sql(gap='even0')} AS h1, {formula_sql(gap='0.0')} AS h0 FROM w0"),
    ("w2", "SELECT *, CASE WHEN h1 > base AND h0 < h1 THEN h0 ELSE h1 END AS hw, CASE WHEN h1 > base AND h0 < h1 THEN 0.0 ELSE even0 END AS evn FROM w1"),
    ("w3", f"""SELECT *, {formula_sql(lane='1.0')} AS row_p, {formula_sql(prev='held')} AS up_p, {formula_sql(sig=_SIG)} AS tsp_p,
      least({formula_sql(prev='held', sig=_SIG, lane='1.0', gap='evn')}, {formula_sql(sig=_SIG, lane='1.0', gap='evn')}, base) AS joint_p FROM w2"""),
    ("w4", """SELECT *, prev_stop_delay + base AS now, greatest(0, base - row_p) AS s_row, greatest(0, base - hw) AS s_hw, greatest(0, base - tsp_p) AS s_tsp,
      greatest(0, prev_stop_delay + base - held - up_p) AS s_up, greatest(0, prev_stop_delay + base - held - joint_p) AS s_joint FROM w3"""),
    ("diag", "SELECT *, greatest(s_hw, s_row, s_tsp) AS s_best, CASE WHEN s_hw >= s_row AND s_hw >= s_tsp THEN 'headway_regularization' WHEN s_row >= s_tsp THEN 'dedicated_row_upgrade' ELSE 'transit_signal_priority' END AS lever FROM w4")]


@query("m14_policy_what_if", observed_oracle("""SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, round(base,4)+0.0 AS predicted_delay, round(hw,4)+0.0 AS headway_regularization_pred, round(up_p,4)+0.0 AS upstream_delay_absorption_pred,
 round(joint_p,4)+0.0 AS joint_multimodal_remedy_pred, round(s_joint,4)+0.0 AS joint_multimodal_remedy_savings, held + joint_p <= 120 AS joint_multimodal_remedy_on_time, round(s_best,4)+0.0 AS max_single_savings FROM diag""",
    [("src", "SELECT * FROM mart"), *WHAT_IF]))
def what_if(spark, sf):
    rows = explain.what_if(stored_observed(spark, sf), formula)
    return comparable(rows.select("trip_id", "stop_sequence", "predicted_delay", "headway_regularization_pred", "upstream_delay_absorption_pred", "joint_multimodal_remedy_pred",
                                  "joint_multimodal_remedy_savings", "joint_multimodal_remedy_on_time", "max_single_savings"), 4)


SEVERE = ("src", "SELECT *, COALESCE(prev_stop_delay >= 180 AND delta_t_run > 0, false) AS piled_up, arrival_delay_seconds <= 900 AS up_to_900 FROM mart WHERE arrival_delay_seconds >= 300")


@query("m15_severe_incidents", observed_oracle("""SELECT piled_up AS is_compounded, up_to_900 AS is_moderate, count(*) AS total_incidents_analyzed, round(avg(arrival_delay_seconds),4) AS mean_observed_delay, round(avg(base),4) AS mean_predicted_delay,
 round(avg(now),4) AS mean_predicted_arrival_delay, round(avg((held + joint_p <= 120)::INTEGER),4) AS joint_recovery_rate, round(avg(s_joint),4) AS joint_mean_reduction_s FROM diag GROUP BY 1, 2""", [SEVERE, *WHAT_IF]))
def severe(spark, sf):
    diagnosed = explain.what_if(explain.severe_incidents(stored_observed(spark, sf)), formula)
    s = explain.policy_summary(diagnosed, by=["is_compounded", "is_moderate"])
    return comparable(s.select("is_compounded", "is_moderate", "total_incidents_analyzed", "mean_observed_delay", "mean_predicted_delay", "mean_predicted_arrival_delay",
                               F.col("joint_multimodal_remedy_recovery_rate").alias("joint_recovery_rate"), F.col("joint_multimodal_remedy_mean_reduction_s").alias("joint_mean_reduction_s")), 4)


SAME = ["hour_of_day", "day_of_week", "is_school_day", "is_public_holiday", "segment_length_meters", "interchange_line_count", "is_metro_proximity", "lane_capacity", "is_tram"]
KNN = [("qs", "SELECT * FROM mart"), ("pool", "SELECT * FROM mart WHERE delta_t_run BETWEEN -60 AND 0"),
    ("sc", "SELECT stddev_pop(prev_stop_delay::DOUBLE) AS sp, stddev_pop(signalized_intersection_count::DOUBLE) AS ss FROM pool"),
    ("prs", """SELECT q.trip_id AS q_trip_id, q.stop_sequence AS q_stop_sequence, p.trip_id AS cf_trip_id, p.stop_sequence AS cf_stop_sequence,
      sqrt(pow((q.prev_stop_delay - p.prev_stop_delay)/sp, 2) + pow((q.signalized_intersection_count - p.signalized_intersection_count)/ss, 2)) AS distance
      FROM qs q JOIN pool p ON """ + " AND ".join(f"q.{c} = p.{c}" for c in SAME) + ", sc")]


@query("m16_nearest_on_target", observed_oracle("""SELECT q_trip_id, q_stop_sequence::BIGINT AS q_stop_sequence, cf_trip_id, cf_stop_sequence::BIGINT AS cf_stop_sequence, round(distance, 6) + 0.0 AS distance FROM prs
  QUALIFY row_number() OVER (PARTITION BY q_trip_id, q_stop_sequence ORDER BY distance, cf_trip_id, cf_stop_sequence) <= 3""", KNN))
def nearest(spark, sf):
    m = stored_observed(spark, sf)
    found = explain.nearest_on_target(m, m, ["trip_id", "stop_sequence"], SAME, ["prev_stop_delay", "signalized_intersection_count"], "delta_t_run", -60.0, 0.0)
    return comparable(found.select("q_trip_id", "q_stop_sequence", "cf_trip_id", "cf_stop_sequence", "distance"))


LINEAR = {"prev_stop_delay": 0.03, "signalized_intersection_count": 2.5, "segment_length_meters": 0.004, "precipitation_mm": 1.5}
_ATTR = "(SELECT " + ", ".join(f"avg(abs({b}::DOUBLE*({f} - (SELECT avg({f}) FROM mart)))) AS {f}" for f, b in LINEAR.items()) + " FROM mart)"


@query("m17_feature_attribution", observed_oracle(" UNION ALL ".join(f"SELECT '{f}' AS feature, round({f}, 6) AS mean_abs, round({f}/({' + '.join(LINEAR)})*100, 6) AS relative_impact_pct FROM {_ATTR}" for f in LINEAR)))
def attribution(spark, sf):
    c = explain.linear_contributions(stored_observed(spark, sf), LINEAR)
    return comparable(explain.mean_absolute_attribution(c, list(LINEAR)))


@query("m17_group_attribution", observed_oracle(f"""SELECT 'Operational Delay Propagation' AS "group", round(prev_stop_delay, 6) AS mean_abs FROM {_ATTR} UNION ALL SELECT 'Infrastructure Bottlenecks', round(signalized_intersection_count, 6) FROM {_ATTR}
  UNION ALL SELECT 'Infrastructure Geometry', round(segment_length_meters, 6) FROM {_ATTR} UNION ALL SELECT 'Meteorological Conditions', round(precipitation_mm, 6) FROM {_ATTR}"""))
def groups(spark, sf):
    c = explain.linear_contributions(stored_observed(spark, sf), LINEAR)
    return comparable(explain.group_attribution(explain.mean_absolute_attribution(c, list(LINEAR))).select("group", "mean_abs"))


_PARTS = " + ".join(f"{b}::DOUBLE*({f} - (SELECT avg({f}) FROM mart))" for f, b in LINEAR.items())


@query("m18_additivity", observed_oracle(f"""SELECT round(max(abs(p - (SELECT avg(p) FROM scored) - ({_PARTS}))), 6) + 0.0 AS max_gap FROM scored""", [SCORED]))
def additivity(spark, sf):
    """The formula has an interaction and features beyond the linear ones, so base plus parts miss it by a gap that the data decide."""
    m = stored_observed(spark, sf)
    base = formula(m).agg(F.avg("prediction")).first()[0]
    return comparable(explain.additivity_gap(explain.linear_contributions(m, LINEAR), formula, list(LINEAR), base))


@query("m19_representative_case", observed_oracle("""SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, round(p, 4) AS prediction, 15::BIGINT AS wishes_met FROM scored WHERE arrival_delay_seconds BETWEEN 300 AND 480 AND delta_t_run > 15 AND prev_stop_delay >= 240
  AND NOT is_dedicated_right_of_way ORDER BY p DESC, trip_id, stop_sequence LIMIT 1""", [SCORED]))
def case(spark, sf):
    return comparable(explain.representative_case(stored_observed(spark, sf), formula).select("trip_id", "stop_sequence", "prediction", "wishes_met"), 4)


@query("t3_extreme_events", observed_oracle("SELECT trip_id, stop_sequence::BIGINT AS stop_sequence, arrival_delay_seconds::BIGINT AS arrival_delay_seconds FROM mart WHERE arrival_delay_seconds >= 600 ORDER BY arrival_delay_seconds DESC, trip_id, stop_sequence LIMIT 25"))
def extreme(spark, sf):
    return comparable(explain.extreme_events(stored_observed(spark, sf), 25).select("trip_id", "stop_sequence", "arrival_delay_seconds"))


def _network_sql(name: str, source: str, p: str, keys: tuple[int, int]) -> list[tuple[str, str]]:
    """One run of the row permutation's network over a table with ``spot``, ``n``, ``h`` (rows), ``w`` (columns) and the position ``p``."""
    def mixed(x: str, key: int) -> str:
        y = f"(({x}) * {explain.MIX_FACTORS[key]} + {explain.MIX_OFFSETS[key]}) % {explain.MIX_PRIME}"
        return f"(({y}) * ({y}) + ({y})) % {explain.MIX_PRIME}"

    return [(f"{name}_r", f"SELECT *, ({p}) AS p, (({p}) // w + {mixed(f'({p}) % w', keys[0])}) % h AS r FROM {source}"),
            (name, f"SELECT spot, n, h, w, CASE WHEN p < h*w THEN r*w + (p % w + {mixed('r', keys[1])}) % w ELSE p END AS q FROM {name}_r")]


MOVED_FEATURES = ["prev_stop_delay", "signalized_intersection_count"]
PERMUTED = [("ranked", "SELECT *, row_number() OVER (ORDER BY trip_id, stop_sequence) - 1 AS spot FROM scored"),
            ("shape", "SELECT n, h, n // h AS w FROM (SELECT n, floor(sqrt(n::DOUBLE))::BIGINT AS h FROM (SELECT count(*) AS n FROM scored))"),
            ("spots", "SELECT spot, n, h, w FROM ranked, shape"),
            *_network_sql("once", "spots", "spot", (0, 1)), *_network_sql("twice", "once", "(q + n // 2) % n", (2, 3)),
            ("exchanged", "SELECT a.*, " + ", ".join(f"b.{f} AS new_{i}" for i, f in enumerate(MOVED_FEATURES)) + " FROM ranked a JOIN twice t ON t.spot = a.spot JOIN ranked b ON b.spot = t.q")]


@query("m17_permutation_importance", observed_oracle(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg(abs(y - {formula_sql(**{k: f'COALESCE(new_{i}, 0)::DOUBLE'})})) - avg(abs(y - p)), 6) + 0.0 AS mae_rise FROM exchanged"
    for i, (f, k) in enumerate(zip(MOVED_FEATURES, ("prev", "sig")))), [SCORED, *PERMUTED]))
def permutation(spark, sf):
    return comparable(explain.permutation_importance(stored_observed(spark, sf), formula, MOVED_FEATURES, "delta_t_run", ["trip_id", "stop_sequence"]))
