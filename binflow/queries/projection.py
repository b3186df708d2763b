"""Checks of the forecasts, the rolling backtest and its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow import adapter as a
from binflow.functions.numbers import half_even as even
from binflow.functions.numbers import half_up as up
from binflow.operators import history
from binflow.plans import evaluation, forecast
from binflow.plans.evaluation import Evaluation
from binflow.plans.forecast import Request
from binflow.queries.duck import add_cte, half_even, with_ctes
from binflow.queries.registry import query
from binflow.session import cut
from binflow.queries.series import INTERVAL, SPLIT, buckets, snapshots

REQUEST = Request(horizon_hours=48, interval_minutes=INTERVAL, critical_level=80.0)
EVALUATION = Evaluation(horizon_hours=48, lookback_days=14, cutoff_count=8, cutoff_spacing_hours=30, min_history_days=7, interval_minutes=INTERVAL)


def forecast_ctes(prefix: str, rows: str, starts: str) -> str:
    """CTEs of a baseline forecast over `rows` (training) from `starts`; returns the name
    of the last one."""
    p = prefix
    add_cte(f"{p}_lag", rows, f"SELECT *, CASE WHEN pl IS NOT NULL THEN {half_even('level - pl', 4)} END AS rise, collected OR coalesce({half_even('greatest(0, pl - level)', 2)}, 0) >= 10 AS ev FROM (SELECT *, lag(level) OVER (PARTITION BY site_id, cutoff ORDER BY timestamp) AS pl FROM {rows})")
    add_cte(f"{p}_inc", f"{p}_lag", f"SELECT site_id, cutoff, rise, isodow(timestamp) - 1 AS wd, hour(timestamp) AS h FROM {p}_lag WHERE NOT ev AND rise > 0")
    add_cte(f"{p}_w", f"{p}_inc", f"SELECT site_id, cutoff, wd, h, median(rise) AS m, count(*) AS n FROM {p}_inc GROUP BY ALL")
    add_cte(f"{p}_h", f"{p}_inc", f"SELECT site_id, cutoff, h, median(rise) AS m, count(*) AS n FROM {p}_inc GROUP BY ALL")
    add_cte(f"{p}_g", f"{p}_inc", f"SELECT site_id, cutoff, median(rise) AS m, count(*) AS n FROM {p}_inc GROUP BY ALL")
    add_cte(f"{p}_n", rows, f"SELECT site_id, cutoff, count(*) AS n FROM {rows} GROUP BY ALL")
    add_cte(
        f"{p}_points",
        f"{starts} {p}_w {p}_h {p}_g {p}_n",
        "SELECT *, " + half_even("raw", 2) + " AS predicted_level, " + half_even("greatest(0, least(100, raw - margin))", 2) + " AS lower_bound, " + half_even("greatest(0, least(100, raw + margin))", 2) + " AS upper_bound FROM ("
        "SELECT *, least(100, greatest(0, least(100, current_level)) + sum(inc * adj) OVER (PARTITION BY site_id, cutoff ORDER BY step)) AS raw FROM ("
        "SELECT f.*, CASE WHEN w.n >= 2 THEN w.m WHEN h.n >= 2 THEN h.m ELSE coalesce(g.m, 1e0) END AS inc,"
        " CASE WHEN f.density_factor IS NULL OR coalesce(g.n, 0) >= 6 THEN 1e0 ELSE least(15e-1, greatest(75e-2, f.density_factor)) END AS adj,"
        " CASE WHEN coalesce(b.n, 0) >= 48 AND coalesce(g.n, 0) >= 12 THEN 85e-2 WHEN coalesce(b.n, 0) >= 12 AND coalesce(g.n, 0) >= 4 THEN 65e-2 ELSE 35e-2 END AS confidence,"
        " CASE WHEN coalesce(b.n, 0) >= 48 AND coalesce(g.n, 0) >= 12 THEN 8e0 WHEN coalesce(b.n, 0) >= 12 AND coalesce(g.n, 0) >= 4 THEN 15e0 ELSE 25e0 END AS margin,"
        " CASE WHEN coalesce(b.n, 0) >= 48 AND coalesce(g.n, 0) >= 12 THEN NULL WHEN coalesce(b.n, 0) >= 12 AND coalesce(g.n, 0) >= 4 THEN 'limited_history' ELSE 'fallback_due_to_low_history' END AS reason"
        f" FROM (SELECT s.*, step, time_bucket(INTERVAL 360 MINUTE, cutoff) + INTERVAL 360 MINUTE * CAST(step + 1 AS INTEGER) AS timestamp FROM {starts} s, range(8) r(step)) f"
        f" LEFT JOIN {p}_w w ON w.site_id = f.site_id AND w.cutoff = f.cutoff AND w.wd = isodow(f.timestamp) - 1 AND w.h = hour(f.timestamp)"
        f" LEFT JOIN {p}_h h ON h.site_id = f.site_id AND h.cutoff = f.cutoff AND h.h = hour(f.timestamp)"
        f" LEFT JOIN {p}_g g ON g.site_id = f.site_id AND g.cutoff = f.cutoff LEFT JOIN {p}_n b ON b.site_id = f.site_id AND b.cutoff = f.cutoff))",
    )
    return f"{p}_points"


add_cte("one_rows", "buckets", f"SELECT *, TIMESTAMP '{SPLIT}' AS cutoff FROM buckets WHERE timestamp <= TIMESTAMP '{SPLIT}'")
add_cte("one_starts", "one_rows", "SELECT site_id, cutoff, arg_max(level, timestamp) AS current_level, CASE WHEN site_id % 3 = 0 THEN NULL ELSE 5e-1 + site_id % 4 END AS density_factor FROM one_rows GROUP BY site_id, cutoff")
forecast_ctes("one", "one_rows", "one_starts")


def _starts(spark, sf):
    at = F.expr(f"timestamp_ntz'{SPLIT}'")
    past = cut(buckets(spark, sf).where(F.col("timestamp") <= at))
    starts = past.groupBy("site_id").agg(F.max_by("level", "timestamp").alias("current_level")).select(
        "site_id", "current_level", at.alias("generated_at"), F.when(F.col("site_id") % 3 != 0, F.lit(0.5) + F.col("site_id") % 4).alias("density_factor")
    )
    return starts, past


@query(
    "i01_baseline_forecast",
    with_ctes("one_points", "SELECT site_id, timestamp, predicted_level, lower_bound, upper_bound, confidence, reason FROM one_points"),
)
def _i01(spark, sf):
    starts, past = _starts(spark, sf)
    return forecast.baseline(starts, past, REQUEST).select("site_id", "timestamp", "predicted_level", "lower_bound", "upper_bound", "confidence", "reason")


@query(
    "i01_stop_at_full",
    with_ctes("one_points", "SELECT site_id, timestamp, predicted_level FROM (SELECT *, lag(raw) OVER (PARTITION BY site_id ORDER BY step) AS b FROM one_points) WHERE coalesce(b < 100, true)"),
)
def _i01s(spark, sf):
    starts, past = _starts(spark, sf)
    r = Request(48, INTERVAL, 80.0, True)
    return forecast.baseline(starts, past, r).select("site_id", "timestamp", "predicted_level")


add_cte("one_lag_all", "one_rows", f"SELECT *, lag(level) OVER (PARTITION BY site_id ORDER BY timestamp) AS pl FROM one_rows")
add_cte("one_rise", "one_lag_all", f"SELECT *, {half_even('level - pl', 4)} AS rise, collected OR coalesce({half_even('greatest(0, pl - level)', 2)}, 0) >= 10 OR coalesce(level < pl, false) AS emptied FROM one_lag_all")
add_cte("one_typ", "one_rise", "SELECT site_id, hour(timestamp) AS h, median(rise) AS m FROM one_rise WHERE rise IS NOT NULL AND NOT emptied GROUP BY ALL")
add_cte("one_all", "one_rise", "SELECT site_id, median(rise) AS m FROM one_rise WHERE rise IS NOT NULL AND NOT emptied GROUP BY ALL")
add_cte(
    "one_gen",
    "one_rise one_typ one_all",
    f"SELECT r.site_id, hour(r.timestamp) AS h, {half_even('CASE WHEN r.pl IS NULL THEN 0e0 WHEN r.emptied THEN coalesce(t.m, o.m, 0e0) ELSE r.rise END', 4)} AS g FROM one_rise r LEFT JOIN one_typ t ON t.site_id = r.site_id AND t.h = hour(r.timestamp) LEFT JOIN one_all o ON o.site_id = r.site_id",
)
add_cte(
    "one_quant",
    "one_starts one_gen",
    "SELECT *, least(100, current_level + sum(greatest(0, q[1])) OVER w) AS lo, least(100, current_level + sum(greatest(0, q[2])) OVER w) AS mid, least(100, current_level + sum(greatest(0, q[3])) OVER w) AS hi FROM (SELECT s.site_id, s.current_level, step,"
    " time_bucket(INTERVAL 360 MINUTE, cutoff) + INTERVAL 360 MINUTE * CAST(step + 1 AS INTEGER) AS timestamp, coalesce(q, [0e0, 0e0, 0e0]) AS q FROM one_starts s, range(8) r(step) LEFT JOIN"
    " (SELECT site_id, h, quantile_cont(g, [0.1, 0.5, 0.9]) AS q FROM one_gen GROUP BY ALL) g ON g.site_id = s.site_id AND g.h = hour(time_bucket(INTERVAL 360 MINUTE, cutoff) + INTERVAL 360 MINUTE * CAST(step + 1 AS INTEGER)))"
    " WINDOW w AS (PARTITION BY site_id ORDER BY step)",
)


@query(
    "i02_seasonal_quantiles",
    with_ctes(
        "one_quant",
        f"SELECT site_id, timestamp, {half_even('mid', 2)} AS predicted_level, {half_even('least(lo, mid)', 2)} AS lower_bound, {half_even('greatest(hi, mid)', 2)} AS upper_bound FROM one_quant",
    ),
)
def _i02(spark, sf):
    starts, past = _starts(spark, sf)
    return forecast.seasonal(starts, past, REQUEST).select("site_id", "timestamp", "predicted_level", "lower_bound", "upper_bound")


add_cte("batch_rows", "buckets", "SELECT *, TIMESTAMP '2024-01-02 12:00:00' AS cutoff FROM buckets WHERE timestamp <= TIMESTAMP '2024-01-02 12:00:00'")
add_cte("batch_starts", "snapshots", "SELECT site_id, TIMESTAMP '2024-01-02 12:00:00' AS cutoff, level AS current_level, CAST(NULL AS DOUBLE) AS density_factor FROM snapshots WHERE complete")
forecast_ctes("batch", "batch_rows", "batch_starts")
add_cte(
    "batch_responses",
    "batch_points snapshots",
    "SELECT p.site_id, any_value(p.current_level) AS current_level, min(CASE WHEN predicted_level >= 80 THEN timestamp END) AS critical_at, min(CASE WHEN predicted_level >= 100 THEN timestamp END) AS full_at, arg_min(p.confidence, step) AS confidence,"
    f" arg_max({half_even('least(capacity_m3, greatest(0, current_volume_m3 + (predicted_level - p.current_level) * capacity_m3 / 100))', 3)}, step) AS final_volume_m3,"
    " min(timestamp) FILTER (timestamp >= TIMESTAMP '2024-01-03 06:00:00') AS target_time, arg_min(predicted_level, timestamp) FILTER (timestamp >= TIMESTAMP '2024-01-03 06:00:00') AS target_level"
    " FROM batch_points p JOIN snapshots s USING (site_id) GROUP BY p.site_id",
)


def _projection(spark, sf):
    at = F.expr("timestamp_ntz'2024-01-02 12:00:00'")
    past = buckets(spark, sf).where(F.col("timestamp") <= at)
    return forecast.project_sites(
        snapshots(spark, sf), past, at, REQUEST, forecast.baseline, None, F.expr("timestamp_ntz'2024-01-03 06:00:00'")
    )


@query(
    "i03_projection_responses",
    with_ctes(
        "batch_responses",
        "SELECT site_id, current_level, critical_at, full_at, " + half_even("(epoch(critical_at) - epoch(TIMESTAMP '2024-01-02 12:00:00')) / 3600e0", 2) + " AS time_to_critical_hours, confidence, final_volume_m3, target_level FROM batch_responses",
    ),
)
def _i03(spark, sf):
    r, _ = _projection(spark, sf)
    return r.select("site_id", "current_level", "critical_at", "full_at", "time_to_critical_hours", "confidence", "final_volume_m3", "target_level")


@query("i04_skipped_sites", with_ctes("snapshots", "SELECT site_id FROM snapshots WHERE NOT complete"))
def _i04(spark, sf):
    return _projection(spark, sf)[1]


@query(
    "d32_projection_summary",
    with_ctes("batch_responses", f"SELECT count(*) AS site_count, count(critical_at) AS sites_reaching_critical, count(full_at) AS sites_reaching_full, {half_even('avg(confidence)', 4)} AS avg_confidence FROM batch_responses"),
)
def _d32(spark, sf):
    return forecast.run_summary(_projection(spark, sf)[0])


@query(
    "h11_projected_volume",
    with_ctes("snapshots", f"SELECT site_id, CASE WHEN capacity_m3 IS NOT NULL THEN {half_even('least(capacity_m3, greatest(0, current_volume_m3 + (80 - level) * capacity_m3 / 100))', 3)} END AS volume FROM snapshots"),
)
def _h11(spark, sf):
    s = snapshots(spark, sf)
    return s.select("site_id", forecast.projected_volume(F.col("current_volume_m3"), F.col("capacity_m3"), F.col("level"), F.lit(80.0)).alias("volume"))


@query(
    "h10_confidence_and_margin",
    with_ctes("one_points", "SELECT site_id, any_value(confidence) AS confidence, any_value(margin) AS margin FROM one_points GROUP BY site_id"),
)
def _h10(spark, sf):
    starts, past = _starts(spark, sf)
    p = forecast.baseline(starts, past, REQUEST).where("step = 0")
    margin = F.when(F.col("confidence") >= 0.8, 8.0).when(F.col("confidence") >= 0.6, 15.0).otherwise(25.0)
    return p.select("site_id", "confidence", margin.alias("margin"))


add_cte(
    "bounds",
    "readings",
    "SELECT earliest, latest, last_cut, CAST(floor((epoch(last_cut) - epoch(TIMESTAMP '2026-01-01')) / 3600e0 / 30) AS BIGINT) AS steps FROM (SELECT min(reading_date) AS earliest, max(reading_date) AS latest, date_trunc('hour', max(reading_date) - INTERVAL 48 HOUR) AS last_cut FROM readings)",
)
add_cte("cuts", "bounds", "SELECT TIMESTAMP '2026-01-01' + INTERVAL 30 HOUR * CAST(steps - i AS INTEGER) AS cutoff FROM bounds, range(8) r(i) WHERE TIMESTAMP '2026-01-01' + INTERVAL 30 HOUR * CAST(steps - i AS INTEGER) - earliest >= INTERVAL 7 DAY")
add_cte("ev_rows", "buckets cuts", "SELECT b.site_id, c.cutoff, b.timestamp, b.level, b.collected, b.timestamp > c.cutoff AS observed FROM buckets b JOIN cuts c ON b.timestamp > c.cutoff - INTERVAL 14 DAY AND b.timestamp <= c.cutoff + INTERVAL 48 HOUR")
add_cte("ev_train", "ev_rows", "SELECT * FROM ev_rows WHERE NOT observed")
add_cte(
    "ev_starts",
    "ev_train cuts buckets",
    "SELECT g.site_id, g.cutoff, coalesce(t.l, 0e0) AS current_level, CAST(NULL AS DOUBLE) AS density_factor FROM (SELECT DISTINCT site_id, cutoff FROM buckets, cuts) g LEFT JOIN (SELECT site_id, cutoff, arg_max(level, timestamp) AS l FROM ev_train GROUP BY ALL) t USING (site_id, cutoff)",
)
forecast_ctes("ev", "ev_train", "ev_starts")
add_cte(
    "ev_rise",
    "ev_rows",
    f"SELECT *, {half_even('level - pl', 4)} AS rise, collected OR coalesce({half_even('greatest(0, pl - level)', 2)}, 0) >= 10 OR coalesce(level < pl, false) AS emptied FROM (SELECT *, lag(level) OVER (PARTITION BY site_id, cutoff ORDER BY timestamp) AS pl FROM ev_rows)",
)
add_cte(
    "ev_truth",
    "ev_rise",
    "SELECT *, coalesce(lag(unc) OVER (PARTITION BY site_id, cutoff ORDER BY timestamp), start_level) AS before FROM (SELECT r.site_id, r.cutoff, r.timestamp, s.start_level, s.start_level + sum(CASE WHEN r.emptied THEN coalesce(t.m, o.m, 0e0) ELSE r.rise END) OVER (PARTITION BY r.site_id, r.cutoff ORDER BY r.timestamp) AS unc"
    " FROM ev_rise r JOIN (SELECT site_id, cutoff, arg_max(level, timestamp) AS start_level FROM ev_rise WHERE NOT observed GROUP BY ALL) s ON s.site_id = r.site_id AND s.cutoff = r.cutoff"
    " LEFT JOIN (SELECT site_id, cutoff, hour(timestamp) AS h, median(rise) AS m FROM ev_rise WHERE NOT observed AND rise IS NOT NULL AND NOT emptied GROUP BY ALL) t ON t.site_id = r.site_id AND t.cutoff = r.cutoff AND t.h = hour(r.timestamp)"
    " LEFT JOIN (SELECT site_id, cutoff, median(rise) AS m FROM ev_rise WHERE NOT observed AND rise IS NOT NULL AND NOT emptied GROUP BY ALL) o ON o.site_id = r.site_id AND o.cutoff = r.cutoff WHERE r.observed)",
)
add_cte(
    "results",
    "ev_points ev_truth",
    f"SELECT a.*, c.observed_critical_at, coalesce(c.cac, false) AS critical_at_cutoff, {half_even('(epoch_us(a.predicted_critical_at) - epoch_us(c.observed_critical_at)) / 3600000000e0', 4)} AS critical_time_error_hours FROM ("
    f"SELECT site_id, cutoff, count(o) AS compared_points, {half_even('avg(ae)', 4)} AS mae, {half_even('sqrt(avg(se))', 4)} AS rmse, min(CASE WHEN predicted_level >= 80 THEN timestamp END) AS predicted_critical_at,"
    " count(*) FILTER (o IS NOT NULL AND predicted_level >= 80 AND o >= 80) AS true_positives, count(*) FILTER (o IS NOT NULL AND predicted_level >= 80 AND o < 80) AS false_positives,"
    " count(*) FILTER (o IS NOT NULL AND predicted_level < 80 AND o >= 80) AS false_negatives, count(*) FILTER (o IS NOT NULL AND predicted_level < 80 AND o < 80) AS true_negatives FROM ("
    f"SELECT p.site_id, p.cutoff, p.timestamp, p.predicted_level, CASE WHEN t.unc IS NOT NULL THEN least(100, t.unc) END AS o, CASE WHEN t.unc IS NOT NULL THEN {half_even('abs(p.predicted_level - least(100, t.unc))', 4)} END AS ae, CASE WHEN t.unc IS NOT NULL THEN {half_even('pow(abs(p.predicted_level - least(100, t.unc)), 2)', 4)} END AS se"
    " FROM ev_points p LEFT JOIN ev_truth t ON t.site_id = p.site_id AND t.cutoff = p.cutoff AND t.timestamp = p.timestamp) GROUP BY site_id, cutoff) a"
    " LEFT JOIN (SELECT site_id, cutoff, min(CASE WHEN before >= 80 OR unc >= 80 THEN timestamp END) AS observed_critical_at, max(start_level) >= 80 AS cac FROM ev_truth GROUP BY ALL) c ON c.site_id = a.site_id AND c.cutoff = a.cutoff",
)


def _cutoffs(spark, sf):
    return evaluation.rolling_cutoffs(history.time_bounds(a.readings(spark, sf)), EVALUATION)


def results(spark, sf):
    return cut(evaluation.backtest(cut(buckets(spark, sf)), cut(_cutoffs(spark, sf)), EVALUATION))


@query("i05_rolling_cutoffs", with_ctes("cuts", "SELECT cutoff FROM cuts"))
def _i05(spark, sf):
    return _cutoffs(spark, sf).select(F.explode("cutoffs").alias("cutoff"))


_RESULT_COLUMNS = "site_id cutoff compared_points mae rmse predicted_critical_at observed_critical_at critical_at_cutoff critical_time_error_hours true_positives false_positives false_negatives true_negatives".split()


@query("i06_backtest", with_ctes("results", f"SELECT {', '.join(_RESULT_COLUMNS)} FROM results"))
def _i06(spark, sf):
    return results(spark, sf).select(*_RESULT_COLUMNS)


@query(
    "d16_error_summary",
    with_ctes(
        "results",
        f"SELECT CAST(sum(compared_points) AS BIGINT) AS compared_points, {half_even('sum(mae * compared_points) FILTER (compared_points > 0) / sum(compared_points)', 4)} AS mae, {half_even('sum(rmse * compared_points) FILTER (compared_points > 0) / sum(compared_points)', 4)} AS rmse,"
        " count(*) AS case_count, count(*) FILTER (critical_at_cutoff) AS critical_at_cutoff, count(DISTINCT site_id) FILTER (observed_critical_at IS NOT NULL) AS sites_with_observed_critical FROM results",
    ),
)
def _d16(spark, sf):
    return evaluation.error_summary(results(spark, sf)).select("compared_points", "mae", "rmse", "case_count", "critical_at_cutoff", "sites_with_observed_critical")


_RATIOS = f"{half_even('true_positives / nullif(true_positives + false_positives, 0)', 4)} AS threshold_precision, {half_even('true_positives / nullif(true_positives + false_negatives, 0)', 4)} AS threshold_recall"
_SUMS = "CAST(sum(true_positives) AS BIGINT) AS true_positives, CAST(sum(false_positives) AS BIGINT) AS false_positives, CAST(sum(false_negatives) AS BIGINT) AS false_negatives, CAST(sum(true_negatives) AS BIGINT) AS true_negatives"


@query("d17_confusion", with_ctes("results", f"SELECT *, {_RATIOS} FROM (SELECT {_SUMS} FROM results)"))
def _d17(spark, sf):
    return evaluation.confusion(results(spark, sf))


add_cte(
    "event_counts",
    "results",
    f"SELECT count(*) AS n, count(*) FILTER (p IS NOT NULL AND o IS NOT NULL AND g >= -3 AND g <= 1) AS tp, count(*) FILTER (p IS NOT NULL AND o IS NOT NULL AND g < -3) AS early, count(*) FILTER (p IS NOT NULL AND o IS NOT NULL AND g > 1) AS late,"
    f" count(*) FILTER (p IS NOT NULL AND o IS NULL) AS fp, count(*) FILTER (p IS NULL AND o IS NOT NULL) AS fn, count(*) FILTER (p IS NULL AND o IS NULL) AS tn, {half_even('avg(abs(g))', 4)} AS mae, {half_even('avg(g)', 4)} AS bias"
    " FROM (SELECT predicted_critical_at AS p, observed_critical_at AS o, critical_time_error_hours AS g FROM results WHERE NOT critical_at_cutoff)",
)


@query(
    "d18_event_metrics",
    with_ctes(
        "event_counts",
        f"SELECT n AS event_cases, tp AS event_true_positives, fp + early AS event_false_positives, fn + late AS event_false_negatives, tn AS event_true_negatives, early AS event_too_early, late AS event_too_late, tp + early + late + fn AS event_observed,"
        f" {half_even('(tp + early + late + fn) / nullif(n, 0)', 4)} AS event_prevalence, pr AS event_precision, re AS event_recall, CASE WHEN pr > 0 AND re > 0 THEN {half_even('2 * pr * re / (pr + re)', 4)} END AS event_f1,"
        f" CASE WHEN hp > 0 AND hr > 0 THEN {half_even('2 * hp * hr / (hp + hr)', 4)} END AS event_horizon_f1, mae AS critical_time_mae_hours, bias AS critical_time_bias_hours FROM (SELECT *, {half_even('tp / nullif(tp + fp + early, 0)', 4)} AS pr, {half_even('tp / nullif(tp + fn + late, 0)', 4)} AS re,"
        f" {half_even('(tp + early + late) / nullif(tp + early + late + fp, 0)', 4)} AS hp, {half_even('(tp + early + late) / nullif(tp + early + late + fn, 0)', 4)} AS hr FROM event_counts)",
    ),
)
def _d18(spark, sf):
    return evaluation.event_metrics(results(spark, sf))


add_cte(
    "merged",
    "results",
    f"SELECT site_id, max(cutoff) AS cutoff, CAST(sum(compared_points) AS BIGINT) AS compared_points, {half_even('sum(mae * compared_points) FILTER (compared_points > 0) / nullif(sum(compared_points), 0)', 4)} AS mae,"
    f" CASE WHEN count(*) = 1 THEN max(rmse) ELSE {half_even('sqrt(' + half_even('sum(rmse * rmse * compared_points) FILTER (compared_points > 0) / nullif(sum(compared_points), 0)', 4) + ')', 4)} END AS rmse,"
    f" CASE WHEN count(*) = 1 THEN max(critical_time_error_hours) ELSE {half_even('avg(abs(critical_time_error_hours))', 4)} END AS critical_time_error_hours, {_SUMS} FROM results GROUP BY site_id",
)


@query("d19_merged_sites", with_ctes("merged", f"SELECT site_id, compared_points, mae, rmse, critical_time_error_hours, true_positives, {_RATIOS} FROM merged"))
def _d19(spark, sf):
    m = evaluation.merge_sites(results(spark, sf))
    return m.select("site_id", "compared_points", "mae", "rmse", "critical_time_error_hours", "true_positives", "threshold_precision", "threshold_recall")


@query(
    "d20_site_report",
    with_ctes("merged", f"SELECT site_id, compared_points AS sample_count, mae, rmse, critical_time_error_hours, {_RATIOS} FROM merged"),
)
def _d20(spark, sf):
    return evaluation.site_report(evaluation.metric_rows(results(spark, sf)))


@query(
    "f03_best_and_worst_sites",
    with_ctes(
        "merged",
        "SELECT site_id, mae, 'best' AS side FROM (SELECT * FROM merged WHERE mae IS NOT NULL ORDER BY mae, site_id LIMIT 10) UNION ALL SELECT site_id, mae, 'worst' FROM (SELECT * FROM merged WHERE mae IS NOT NULL ORDER BY mae DESC, site_id DESC LIMIT 10)",
    ),
)
def _f03(spark, sf):
    return evaluation.extremes(evaluation.merge_sites(results(spark, sf)).select("site_id", "mae"))


@query(
    "i07_evaluation_metrics",
    with_ctes(
        "merged event_counts",
        "SELECT 'site' AS metric_scope, site_id, compared_points AS sample_count, 'mae' AS metric_key, mae AS metric_value FROM merged UNION ALL SELECT 'site', site_id, compared_points, 'rmse', rmse FROM merged"
        " UNION ALL SELECT 'global', NULL, n, 'event_true_positives', CAST(tp AS DOUBLE) FROM event_counts UNION ALL SELECT 'global', NULL, n, 'event_too_late', CAST(late AS DOUBLE) FROM event_counts"
        f" UNION ALL SELECT 'global', NULL, CAST(sum(compared_points) AS BIGINT), 'mae', {half_even('sum(mae * compared_points) FILTER (compared_points > 0) / sum(compared_points)', 4)} FROM results",
    ),
)
def _i07(spark, sf):
    e = EVALUATION
    samples = a.samples(spark, sf)
    m = evaluation.evaluate(samples, history.time_bounds(a.readings(spark, sf)), e, carry=1080)
    site = (F.col("metric_scope") == "site") & F.col("metric_key").isin("mae", "rmse")
    total = (F.col("metric_scope") == "global") & F.col("metric_key").isin("mae", "event_true_positives", "event_too_late")
    return m.where(site | total)
