"""Fill forecasts per site, as DataFrame functions.

A forecaster takes `starts` (one row per series: the keys, generated_at,
current_level, density_factor) and `history` (bucket rows under the same keys) and
returns points. Keys are `site_id`, or `site_id, cutoff` in a backtest, so one job
forecasts every site and cutoff together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.functions import times
from binflow.functions.numbers import clamp, half_even
from binflow.operators import history as series
from binflow.session import cut


@dataclass(frozen=True)
class Request:
    horizon_hours: float = 24
    interval_minutes: int = 60
    critical_level: float = 80.0
    stop_at_full: bool = False

    @property
    def steps(self) -> int:
        return max(1, int(self.horizon_hours * 60 / self.interval_minutes))


Forecaster = Callable[[DataFrame, DataFrame, Request, Sequence[str]], DataFrame]


def _future(starts: DataFrame, request: Request) -> DataFrame:
    """One row per series and step; the grid starts strictly after generated_at."""
    first = times.ceil_to_next_interval(F.col("generated_at"), request.interval_minutes)
    step = F.explode(F.sequence(F.lit(0), F.lit(request.steps - 1))).alias("step")
    return starts.select("*", step).withColumn(
        "timestamp", times.plus_minutes(first, F.col("step") * request.interval_minutes)
    )


def _stop_at_full(points: DataFrame, request: Request, keys: Sequence[str]) -> DataFrame:
    if not request.stop_at_full:
        return points
    before = F.lag("raw_level").over(Window.partitionBy(*keys).orderBy("step"))
    return points.withColumn("before", before).where(F.coalesce(F.col("before") < 100, F.lit(True))).drop("before")


def _running(value: Column, keys: Sequence[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0))


def baseline(starts: DataFrame, history: DataFrame, request: Request, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Adds the median increment of the same weekday and hour, else hour, else overall.

    Increments are never negative, so clamping once after the running sum equals
    clamping at each step.
    """
    k = list(keys)
    profile = series.increment_profile(history, keys)
    rows = _future(starts.join(profile, k, "left"), request)
    increments, seen = F.coalesce("increments", F.lit(0)), F.coalesce("bucket_count", F.lit(0))
    slot = F.weekday("timestamp") * 24 + F.hour("timestamp")
    weekly, hourly = F.col("weekly")[slot], F.col("hourly")[F.hour("timestamp")]
    increment = (
        F.when(weekly["n"] >= 2, weekly["m"]).when(hourly["n"] >= 2, hourly["m"]).otherwise(F.coalesce("overall", F.lit(1.0)))
    )
    adjustment = F.when(F.col("density_factor").isNull() | (increments >= 6), F.lit(1.0)).otherwise(clamp(F.col("density_factor"), 0.75, 1.5))
    rich, fair = (seen >= 48) & (increments >= 12), (seen >= 12) & (increments >= 4)
    confidence = F.when(rich, 0.85).when(fair, 0.65).otherwise(0.35)
    margin = F.when(rich, 8.0).when(fair, 15.0).otherwise(25.0)
    reason = F.when(rich, None).when(fair, "limited_history").otherwise("fallback_due_to_low_history")
    raw = F.least(F.lit(100.0), clamp(F.col("current_level"), 0, 100) + _running(increment * adjustment, keys))
    points = rows.withColumn("raw_level", raw).withColumn("confidence", confidence).withColumn("margin", margin).withColumn("reason", reason)
    points = _stop_at_full(points, request, keys)
    level = F.col("raw_level")
    return points.select(
        *k,
        "generated_at",
        "current_level",
        "step",
        "timestamp",
        half_even(level, 2).alias("predicted_level"),
        half_even(clamp(level - F.col("margin"), 0, 100), 2).alias("lower_bound"),
        half_even(clamp(level + F.col("margin"), 0, 100), 2).alias("upper_bound"),
        "confidence",
        "reason",
    )


def with_snapshot(starts: DataFrame, history: DataFrame, interval: int, keys: Sequence[str]) -> DataFrame:
    """History whose bucket at snapshot_at carries the current level (added if absent);
    unchanged when the starts have no snapshot time, as in a backtest."""
    k = list(keys)
    if "snapshot_at" not in starts.columns:
        return history
    now = starts.select(
        *k, times.floor_to_interval(F.col("snapshot_at"), interval).alias("timestamp"), F.col("current_level").alias("snapshot_level")
    )
    h = history.select(*k, "timestamp", "level", "collected")
    merged = h.join(now, [*k, "timestamp"], "full")
    return merged.select(
        *k, "timestamp", F.coalesce("snapshot_level", "level").alias("level"), F.coalesce("collected", F.lit(False)).alias("collected")
    )


def from_quantiles(starts: DataFrame, history: DataFrame, quantiles: DataFrame, request: Request, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Points from per-step generation quantiles (keys, step, low, mid, high) of any model.

    Negatives count as zero, quantiles accumulate from the last level, bounds keep their
    order, confidence follows the spread. Series with fewer than four buckets or without
    quantiles rise one point per step.
    """
    k = list(keys)
    h = with_snapshot(starts, history, request.interval_minutes, keys)
    shape = h.groupBy(*k).agg(F.count("*").alias("buckets"), F.max_by("level", "timestamp").alias("last_level"))
    original = history.groupBy(*k).agg(F.count("*").alias("own_buckets"))
    rows = _future(starts.join(shape, k, "left").join(original, k, "left"), request).join(quantiles, [*k, "step"], "left")
    enough = (F.coalesce("buckets", F.lit(0)) >= 4) & F.col("mid").isNotNull()
    base = F.coalesce("last_level", "current_level")

    def level(q: str) -> Column:
        return clamp(base + _running(F.greatest(F.lit(0.0), F.coalesce(q, F.lit(0.0))), keys), 0, 100)

    flat = F.least(F.lit(100.0), clamp(base, 0, 100) + F.col("step") + 1)
    rows = (
        rows.withColumn("low_level", level("low"))
        .withColumn("mid_level", level("mid"))
        .withColumn("high_level", level("high"))
        .withColumn("enough", enough)
        .withColumn("raw_level", F.when(enough, F.col("mid_level")).otherwise(flat))
    )
    rows = _stop_at_full(rows, request, keys)
    mid = F.col("raw_level")
    lower = F.when(F.col("enough"), F.least("low_level", mid)).otherwise(clamp(mid - 15, 0, 100))
    upper = F.when(F.col("enough"), F.greatest("high_level", mid)).otherwise(clamp(mid + 15, 0, 100))
    well = F.coalesce("own_buckets", F.lit(0)) >= 24
    spread = upper - lower
    confidence = (
        F.when(~F.col("enough"), 0.35)
        .when(spread > 30, F.when(well, 0.6).otherwise(0.45))
        .when(spread > 15, F.when(well, 0.75).otherwise(0.6))
        .otherwise(F.when(well, 0.85).otherwise(0.7))
    )
    return rows.select(
        *k, "generated_at", "current_level", "step", "timestamp",
        half_even(mid, 2).alias("predicted_level"), half_even(lower, 2).alias("lower_bound"), half_even(upper, 2).alias("upper_bound"),
        confidence.alias("confidence"), F.when(~F.col("enough"), "insufficient_history").alias("reason"),
    )


def seasonal_quantiles(starts: DataFrame, history: DataFrame, request: Request, keys: Sequence[str] = ("site_id",), levels: tuple[float, float, float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Built-in quantile model: empirical quantiles of the generation at the same hour."""
    k = list(keys)
    h = with_snapshot(starts, history, request.interval_minutes, keys)
    grown = series.generation(h, keys)
    by_hour = grown.groupBy(*k, F.hour("timestamp").alias("hour")).agg(F.percentile("generation", list(levels)).alias("q"))
    rows = _future(starts.select(*k, "generated_at"), request).withColumn("hour", F.hour("timestamp"))
    return rows.join(by_hour, [*k, "hour"], "left").select(
        *k, "step", F.coalesce(F.col("q")[0], F.lit(0.0)).alias("low"), F.coalesce(F.col("q")[1], F.lit(0.0)).alias("mid"), F.coalesce(F.col("q")[2], F.lit(0.0)).alias("high")
    )


def seasonal(starts: DataFrame, history: DataFrame, request: Request, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    history = cut(history)
    return from_quantiles(starts, history, seasonal_quantiles(starts, history, request, keys), request, keys)


def projected_volume(current: Column, capacity: Column, start: Column, predicted: Column) -> Column:
    """Volume moved by the level change, within 0 and capacity; null when unknown."""
    raw = current + (predicted - start) * capacity / 100
    return F.when(raw.isNotNull(), half_even(F.least(capacity, F.greatest(F.lit(0.0), raw)), 3))


def responses(points: DataFrame, volumes: DataFrame, request: Request, target_at: Column | None = None) -> DataFrame:
    """One row per site: crossings, hours to them, first confidence, and the first point
    at or after a target time."""
    p = points.join(volumes, "site_id", "left").withColumn(
        "predicted_volume_m3",
        projected_volume(F.col("current_volume_m3"), F.col("capacity_m3"), F.col("current_level"), F.col("predicted_level")),
    )

    def reached(level: float) -> Column:
        return F.min(F.when(F.col("predicted_level") >= level, F.col("timestamp")))

    wanted = [
        reached(request.critical_level).alias("critical_at"),
        reached(100.0).alias("full_at"),
        F.min_by("confidence", "step").alias("confidence"),
        F.min_by("reason", "step").alias("reason"),
        F.max_by("predicted_volume_m3", "step").alias("final_volume_m3"),
        F.max_by("predicted_level", "step").alias("final_level"),
        F.count("*").alias("points"),
    ]
    if target_at is not None:
        late = F.col("timestamp") >= target_at
        wanted.append(F.min_by(F.when(late, F.col("predicted_level")), F.when(late, F.col("timestamp"))).alias("target_level"))
    rolled = p.groupBy("site_id", "generated_at", "current_level").agg(*wanted)
    for name in ("critical", "full"):
        rolled = rolled.withColumn(
            f"time_to_{name}_hours", half_even(times.hours_between(F.col("generated_at"), F.col(f"{name}_at")), 2)
        )
    return rolled


def run_summary(response_rows: DataFrame) -> DataFrame:
    return response_rows.agg(
        F.count("*").alias("site_count"),
        F.count("critical_at").alias("sites_reaching_critical"),
        F.count("full_at").alias("sites_reaching_full"),
        F.coalesce(half_even(F.avg("confidence"), 4), F.lit(0.0)).alias("avg_confidence"),
    )


def project_sites(
    snapshots: DataFrame, history: DataFrame, as_of: Column, request: Request, model: Forecaster = baseline,
    features: DataFrame | None = None, target_at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Every complete site of `snapshots` projected from `as_of`; the second frame lists
    the sites skipped for lack of readings."""
    snapshots = cut(snapshots)
    ready = snapshots.where("complete")
    starts = ready.select("site_id", as_of.alias("generated_at"), as_of.alias("snapshot_at"), F.col("level").alias("current_level"))
    if features is not None:
        starts = starts.join(features.select("site_id", "density_factor"), "site_id", "left")
    else:
        starts = starts.withColumn("density_factor", F.lit(None).cast("double"))
    points = model(starts, history, request, ("site_id",))
    volumes = ready.select("site_id", "current_volume_m3", "capacity_m3")
    skipped = snapshots.where(~F.col("complete")).select("site_id")
    return responses(points, volumes, request, target_at), skipped


def pandas_model(forecast_series, schema_step: str = "step int, low double, mid double, high double", keys: Sequence[str] = ("site_id",)) -> Forecaster:
    """Wrap a pandas model of generation quantiles as a forecaster.

    `forecast_series(frame, steps)` gets one series (timestamp, generation), whose length
    is bounded by the lookback window, and returns step, low, mid, high.
    """

    def run(starts: DataFrame, history: DataFrame, request: Request, run_keys: Sequence[str] = keys) -> DataFrame:
        k = list(run_keys)
        history = cut(history)
        h = with_snapshot(starts, history, request.interval_minutes, k)
        grown = series.generation(h, k).select(*k, "timestamp", "generation")
        types = dict(grown.dtypes)
        schema = ", ".join(f"{name} {types[name]}" for name in k) + ", " + schema_step
        steps = request.steps

        def one(frame):
            out = forecast_series(frame.sort_values("timestamp"), steps)
            for position, name in enumerate(k):
                out.insert(position, name, frame[name].iloc[0])
            return out

        return from_quantiles(starts, history, grown.groupBy(*k).applyInPandas(one, schema), request, k)

    return run


# The forecaster registry: model key -> function.
FORECASTERS: dict[str, Forecaster] = {"baseline_operational": baseline, "seasonal_quantiles": seasonal}


def register(key: str, model: Forecaster) -> None:
    FORECASTERS[key] = model


def forecaster(key: str) -> Forecaster:
    if key not in FORECASTERS:
        raise KeyError(f"unknown projection model: {key}")
    return FORECASTERS[key]
