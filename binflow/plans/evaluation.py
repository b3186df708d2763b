"""Rolling backtests of the forecasters and their metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.functions import times
from binflow.functions.numbers import half_even, ratio
from binflow.operators import history as series
from binflow.plans import forecast
from binflow.plans.forecast import Forecaster, Request
from binflow.session import cut

KEYS = ("site_id", "cutoff")
# Fixed value: origin of the cutoff grid.
ANCHOR = "timestamp_ntz'2026-01-01 00:00:00'"


@dataclass(frozen=True)
class Evaluation:
    horizon_hours: int = 24
    lookback_days: int = 14
    cutoff_count: int = 14
    cutoff_spacing_hours: int = 13
    min_history_days: int = 7
    interval_minutes: int = 60
    critical_level: float = 80.0
    early_hours: float = 3.0
    late_hours: float = 1.0
    stop_at_full: bool = False

    @property
    def request(self) -> Request:
        return Request(self.horizon_hours, self.interval_minutes, self.critical_level, self.stop_at_full)


def rolling_cutoffs(bounds: DataFrame, e: Evaluation) -> DataFrame:
    """One row (cutoffs array, short_history) from the readings' earliest and latest time.

    Cutoffs lie on a grid anchored at a fixed origin, newest first kept, those with too
    little history dropped; when none is left, the latest alone with short_history.
    """
    latest = times.floor_to_interval(times.plus_minutes(F.col("latest"), -60 * e.horizon_hours), 60)
    anchor, spacing = F.expr(ANCHOR), e.cutoff_spacing_hours
    steps = F.floor(times.hours_between(anchor, F.col("last")) / spacing).cast("int")
    grid = F.transform(
        F.sequence(F.lit(e.cutoff_count - 1), F.lit(0), F.lit(-1)),
        lambda i: times.plus_minutes(anchor, (F.col("steps") - i) * (60 * spacing)),
    )
    old_enough = F.filter(
        F.col("grid"), lambda c: c >= times.plus_minutes(F.col("earliest"), 1440 * e.min_history_days)
    )
    valid = (F.col("last") >= F.col("earliest")) & (F.col("last") < F.col("latest"))
    return (
        bounds.withColumn("last", latest)
        .where(valid)
        .withColumn("steps", steps)
        .withColumn("grid", grid)
        .withColumn("kept", old_enough)
        .select(
            F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.array("last")).alias("cutoffs"),
            (F.size("kept") == 0).alias("short_history"),
        )
    )


def evaluation_rows(buckets: DataFrame, cutoffs: DataFrame, e: Evaluation) -> DataFrame:
    """Bucket rows under each cutoff they train or test, by exploding the short cutoff
    array of one broadcast row; `observed` marks the test side."""
    one = cutoffs.select("cutoffs", F.lit(1).alias("one"))
    joined = buckets.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").drop("one")
    ts = F.col("timestamp")
    used = F.filter(
        F.col("cutoffs"),
        lambda c: (ts > times.plus_minutes(c, -1440 * e.lookback_days)) & (ts <= times.plus_minutes(c, 60 * e.horizon_hours)),
    )
    return (
        joined.withColumn("cutoff", F.explode(used)).drop("cutoffs").withColumn("observed", F.col("timestamp") > F.col("cutoff"))
    )


def _starts(sites: DataFrame, rows: DataFrame, cutoffs: DataFrame, features: DataFrame | None) -> DataFrame:
    grid = sites.select("site_id").distinct().withColumn("one", F.lit(1)).join(
        F.broadcast(cutoffs.select("cutoffs", F.lit(1).alias("one"))), "one"
    )
    grid = grid.select("site_id", F.explode("cutoffs").alias("cutoff"))
    last = rows.where(~F.col("observed")).groupBy(*KEYS).agg(F.max_by("level", "timestamp").alias("current_level"))
    starts = grid.join(last, list(KEYS), "left").select(
        *KEYS, F.col("cutoff").alias("generated_at"), F.coalesce("current_level", F.lit(0.0)).alias("current_level")
    )
    if features is None:
        return starts.withColumn("density_factor", F.lit(None).cast("double"))
    return starts.join(features.select("site_id", "density_factor"), "site_id", "left")


def backtest(buckets: DataFrame, cutoffs: DataFrame, e: Evaluation, model: Forecaster = forecast.baseline, features: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """One row per (site, cutoff): errors against the uncollected level, crossings and
    the confusion counts. All cutoffs run in the same job."""
    k = list(KEYS)
    # Read by the starts, the training and the truth: stored once.
    rows = cut(evaluation_rows(buckets, cutoffs, e))
    starts = _starts(buckets if sites is None else sites, rows, cutoffs, features)
    points = model(starts, rows.where(~F.col("observed")).select(*k, "timestamp", "level", "collected"), e.request, KEYS)
    truth = series.uncollected_levels(rows.select(*k, "timestamp", "level", "collected", "observed"), KEYS)
    reference = truth.select(*k, "timestamp", F.least(F.lit(100.0), F.col("uncollected")).alias("observed_level"))
    critical = F.lit(float(e.critical_level))
    error = F.abs(F.col("predicted_level") - F.col("observed_level"))
    hit, real = F.col("predicted_level") >= critical, F.col("observed_level") >= critical
    compared = F.col("observed_level").isNotNull()
    scored = (
        points.join(reference, [*k, "timestamp"], "left")
        .withColumn("absolute_error", half_even(error, 4))
        .withColumn("squared_error", half_even(error * error, 4))
        .groupBy(*k)
        .agg(
            F.count("observed_level").alias("compared_points"),
            half_even(F.avg("absolute_error"), 4).alias("mae"),
            half_even(F.sqrt(F.avg("squared_error")), 4).alias("rmse"),
            F.min(F.when(hit, F.col("timestamp"))).alias("predicted_critical_at"),
            F.count_if(compared & hit & real).alias("true_positives"),
            F.count_if(compared & hit & ~real).alias("false_positives"),
            F.count_if(compared & ~hit & real).alias("false_negatives"),
            F.count_if(compared & ~hit & ~real).alias("true_negatives"),
        )
    )
    crossed = series.first_crossing(truth, e.critical_level, KEYS).withColumnRenamed("crossed_at", "observed_critical_at")
    at_cutoff = truth.groupBy(*k).agg((F.max("start_level") >= critical).alias("critical_at_cutoff"))
    gap = times.hours_between(F.col("observed_critical_at"), F.col("predicted_critical_at"))
    return (
        scored.join(crossed, k, "left")
        .join(at_cutoff, k, "left")
        .withColumn("critical_at_cutoff", F.coalesce("critical_at_cutoff", F.lit(False)))
        .withColumn("critical_time_error_hours", half_even(gap, 4))
    )


def _precision() -> Column:
    return ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives"))


def _recall() -> Column:
    return ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_negatives"))


def with_ratios(results: DataFrame) -> DataFrame:
    return results.withColumn("threshold_precision", _precision()).withColumn("threshold_recall", _recall())


def _weighted(value: str, weight: str = "compared_points") -> Column:
    usable = F.col(value).isNotNull() & (F.col(weight) > 0)
    total = F.sum(F.when(usable, F.col(weight)))
    return F.sum(F.when(usable, F.col(value) * F.col(weight))) / total


def error_summary(results: DataFrame) -> DataFrame:
    """Global MAE and RMSE weighted by compared points."""
    return results.agg(
        F.count_distinct("site_id").alias("site_count"),
        F.count_distinct("cutoff").alias("cutoff_count"),
        F.count("*").alias("case_count"),
        F.count_if("critical_at_cutoff").alias("critical_at_cutoff"),
        F.coalesce(F.sum("compared_points"), F.lit(0).cast("bigint")).alias("compared_points"),
        half_even(_weighted("mae"), 4).alias("mae"),
        half_even(_weighted("rmse"), 4).alias("rmse"),
        F.count_distinct(F.when(F.col("observed_critical_at").isNotNull(), F.col("site_id"))).alias("sites_with_observed_critical"),
        F.count_distinct(F.when(F.col("predicted_critical_at").isNotNull(), F.col("site_id"))).alias("sites_with_predicted_critical"),
    )


def confusion_totals(results: DataFrame, *more: Column) -> DataFrame:
    names = ("true_positives", "false_positives", "false_negatives", "true_negatives")
    return with_ratios(results.agg(*[F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in names], *more))


def confusion(results: DataFrame) -> DataFrame:
    """Counts summed over all cases, then the ratios."""
    return confusion_totals(results)


def _f1(precision: Column, recall: Column) -> Column:
    usable = (F.coalesce(precision, F.lit(0.0)) > 0) & (F.coalesce(recall, F.lit(0.0)) > 0)
    return F.when(usable, half_even(2 * precision * recall / (precision + recall), 4))


def event_metrics(results: DataFrame, early: float = 3.0, late: float = 1.0) -> DataFrame:
    """Crossing events: one case per (site, cutoff) not already critical. A warning counts
    when it comes at most `early` hours before and `late` hours after the crossing."""
    said, real = F.col("predicted_critical_at").isNotNull(), F.col("observed_critical_at").isNotNull()
    gap = F.col("critical_time_error_hours")
    both = said & real
    counted = results.where(~F.col("critical_at_cutoff")).agg(
        F.count("*").alias("cases"),
        F.count_if(both & (gap >= -early) & (gap <= late)).alias("tp"),
        F.count_if(both & (gap < -early)).alias("too_early"),
        F.count_if(both & (gap > late)).alias("too_late"),
        F.count_if(said & ~real).alias("fp"),
        F.count_if(~said & real).alias("fn"),
        F.count_if(~said & ~real).alias("tn"),
        half_even(F.avg(F.abs(gap)), 4).alias("critical_time_mae_hours"),
        half_even(F.avg(gap), 4).alias("critical_time_bias_hours"),
    )
    tp, fp, fn, early_n, late_n = (F.col(c) for c in ("tp", "fp", "fn", "too_early", "too_late"))
    detected = tp + early_n + late_n
    d = counted.withColumn("p", ratio(tp, tp + fp + early_n)).withColumn("r", ratio(tp, tp + fn + late_n))
    return d.select(
        F.col("cases").alias("event_cases"),
        tp.alias("event_true_positives"),
        (fp + early_n).alias("event_false_positives"),
        (fn + late_n).alias("event_false_negatives"),
        F.col("tn").alias("event_true_negatives"),
        early_n.alias("event_too_early"),
        late_n.alias("event_too_late"),
        (detected + fn).alias("event_observed"),
        ratio(detected + fn, F.col("cases")).alias("event_prevalence"),
        F.col("p").alias("event_precision"),
        F.col("r").alias("event_recall"),
        _f1(F.col("p"), F.col("r")).alias("event_f1"),
        _f1(ratio(detected, detected + fp), ratio(detected, detected + fn)).alias("event_horizon_f1"),
        "critical_time_mae_hours",
        "critical_time_bias_hours",
    )


def merge_sites(results: DataFrame) -> DataFrame:
    """One row per site over its cutoffs; a single case keeps its signed time error."""
    names = ("true_positives", "false_positives", "false_negatives", "true_negatives")
    single = F.count("*") == 1
    gap = F.col("critical_time_error_hours")
    squared = F.when(F.col("rmse").isNotNull(), F.col("rmse") * F.col("rmse"))
    merged = (
        results.withColumn("mse", squared)
        .groupBy("site_id")
        .agg(
            F.max("cutoff").alias("cutoff"),
            F.sum("compared_points").alias("compared_points"),
            half_even(_weighted("mae"), 4).alias("mae"),
            F.when(single, F.max("rmse")).otherwise(half_even(F.sqrt(half_even(_weighted("mse"), 4)), 4)).alias("rmse"),
            F.when(single, F.max(gap)).otherwise(half_even(F.avg(F.abs(gap)), 4)).alias("critical_time_error_hours"),
            F.when(single, F.max("predicted_critical_at")).alias("predicted_critical_at"),
            F.when(single, F.max("observed_critical_at")).alias("observed_critical_at"),
            *[F.sum(n).alias(n) for n in names],
        )
    )
    return with_ratios(merged)


def _long(df: DataFrame, scope: str, count: str, columns: Sequence[str], site: bool) -> DataFrame:
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("metric_key"), F.col(c).cast("double").alias("metric_value")) for c in columns]))
    return df.select(
        F.lit(scope).alias("metric_scope"),
        (F.col("site_id") if site else F.lit(None).cast("bigint")).alias("site_id"),
        F.col(count).alias("sample_count"),
        entries.alias("m"),
    ).select("metric_scope", "site_id", "sample_count", "m.metric_key", "m.metric_value")


def metric_rows(results: DataFrame, early: float = 3.0, late: float = 1.0) -> DataFrame:
    """Long table of global and per-site metrics."""
    errors = error_summary(results)
    points = F.coalesce(F.sum("compared_points"), F.lit(0).cast("bigint")).alias("compared_points")
    counts = confusion_totals(results, points)
    renamed = counts.select(
        "compared_points",
        *[F.col(n).alias(f"threshold_{n}") for n in ("true_positives", "false_positives", "false_negatives", "true_negatives")],
        "threshold_precision",
        "threshold_recall",
    )
    events = event_metrics(results, early, late)
    return (
        _long(errors, "global", "compared_points", ("mae", "rmse"), False)
        .unionByName(_long(renamed, "global", "compared_points", [c for c in renamed.columns if c != "compared_points"], False))
        .unionByName(_long(events, "global", "event_cases", [c for c in events.columns if c != "event_cases"], False))
        .unionByName(
            _long(
                merge_sites(results), "site", "compared_points",
                ("mae", "rmse", "critical_time_error_hours", "threshold_precision", "threshold_recall"), True,
            )
        )
    )


SITE_METRICS = ("mae", "rmse", "critical_time_error_hours", "threshold_precision", "threshold_recall")


def site_report(metrics: DataFrame) -> DataFrame:
    """Site metrics back in one row per site."""
    return (
        metrics.where(F.col("metric_scope") == "site")
        .groupBy("site_id", "sample_count")
        .pivot("metric_key", list(SITE_METRICS))
        .agg(F.first("metric_value"))
    )


def extremes(report: DataFrame, count: int = 10) -> DataFrame:
    """Best and worst sites by MAE."""
    ranked = report.where(F.col("mae").isNotNull())
    best = ranked.orderBy("mae", "site_id").limit(count).withColumn("side", F.lit("best"))
    worst = ranked.orderBy(F.col("mae").desc(), F.col("site_id").desc()).limit(count).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def evaluate(samples: DataFrame, bounds: DataFrame, e: Evaluation, model: Forecaster = forecast.baseline, how: str = "avg", carry: int = series.MAX_CARRY_MINUTES, features: DataFrame | None = None) -> DataFrame:
    """Whole run: cutoffs, buckets, backtest, long metrics."""
    cutoffs = cut(rolling_cutoffs(bounds, e))
    buckets = cut(series.site_buckets(samples, e.interval_minutes, how, carry))
    return metric_rows(cut(backtest(buckets, cutoffs, e, model, features)), e.early_hours, e.late_hours)
