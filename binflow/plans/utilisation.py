"""Site utilisation metrics and the score-based redistribution plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.functions import levels, times
from binflow.functions.numbers import half_even, half_up
from binflow.operators import spatial
from binflow.plans.rounds import Chosen, remaining
from binflow.session import attach, cut, small

# Level counted as peak, level counted as overflow, overflow count that
# saturates the score, score weights.
PEAK_LEVEL, OVERFLOW_LEVEL, OVERFLOW_CAP = 80, 100, 50.0
WEIGHT_FILL, WEIGHT_PEAK, WEIGHT_OVERFLOW = 0.4, 0.3, 0.3


@dataclass(frozen=True)
class ScoreConfig:
    min_utilization_donor: float = 0.35
    target_utilization: float = 0.5
    min_utilization_receiver: float = 0.65
    max_distance_km: float = 1.0
    window_days: int | None = None
    apply_capacity: bool = True

    def __post_init__(self) -> None:
        if not self.min_utilization_donor < self.target_utilization < self.min_utilization_receiver:
            raise ValueError("donor bound < target < receiver bound")

    @property
    def safe_donor_fill(self) -> float:
        return min(75.0, max(50.0, self.target_utilization * 100.0 + 10.0))


def reading_metrics(readings: DataFrame, window_days: int | None = None) -> DataFrame:
    """Mean level, peak rate, overflow and reading counts per site over the window that
    ends at the newest reading. One partial aggregate; a crowded site costs no extra."""
    r = readings.where(F.col("level").isNotNull() & F.col("site_id").isNotNull())
    if window_days is not None:
        # A scalar subquery reaches the scan as a filter once the clock is known.
        start = r.agg(times.plus_minutes(F.max("reading_date"), -1440 * window_days)).scalar()
        r = r.where(F.col("reading_date") >= start)
    level = F.col("level")
    return r.groupBy("site_id").agg(
        half_up(F.avg(level), 2).alias("avg_fill"),
        half_up(F.avg(F.when(level >= PEAK_LEVEL, 1.0).otherwise(0.0)), 4).alias("peak_rate"),
        F.count_if(level >= OVERFLOW_LEVEL).alias("overflow_count"),
        F.count("*").alias("reading_count"),
    )


def utilisation(sites: DataFrame, containers: DataFrame, metrics: DataFrame, capacity: DataFrame | None = None) -> DataFrame:
    """One row per active site: counts, fill, score, category. Sites without readings
    fall back to the containers' current mean; sites without containers score zero."""
    current = (
        containers.where(F.col("deleted_at").isNull())
        .groupBy("site_id")
        .agg(
            F.count("*").alias("container_count"),
            F.min("container_type_id").alias("container_type_id"),
            half_up(F.avg("current_level"), 0).alias("current_fill"),
        )
    )
    base = sites.where(F.col("deleted_at").isNull()).select(
        F.col("id").alias("site_id"), F.col("name").alias("site_name"), "latitude", "longitude", "waste_type_id"
    )
    rows = base.join(current, "site_id", "left").join(metrics, "site_id", "left")
    empty = F.coalesce("container_count", F.lit(0)) == 0
    fill = F.coalesce("avg_fill", "current_fill", F.lit(0.0))
    peak = F.coalesce("peak_rate", F.lit(0.0))
    overflow = F.coalesce("overflow_count", F.lit(0))
    raw = (
        F.least(fill / 100, F.lit(1.0)) * WEIGHT_FILL
        + peak * WEIGHT_PEAK
        + F.least(overflow / OVERFLOW_CAP, F.lit(1.0)) * WEIGHT_OVERFLOW
    )
    score = half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)
    out = rows.select(
        "site_id", "site_name", "latitude", "longitude", "waste_type_id", "container_type_id",
        F.coalesce("container_count", F.lit(0).cast("bigint")).alias("container_count"),
        F.when(empty, F.lit(0.0)).otherwise(half_even(fill, 2)).alias("avg_fill_level"),
        F.when(empty, F.lit(0.0)).otherwise(half_even(peak, 4)).alias("peak_fill_rate"),
        F.when(empty, F.lit(0)).otherwise(overflow).cast("bigint").alias("overflow_frequency"),
        F.when(empty, F.lit(0.0)).otherwise(score).alias("utilization_score"),
    ).withColumn("category", levels.score_category(F.col("utilization_score")))
    if capacity is None:
        return out.withColumn("max_containers", F.lit(None).cast("int"))
    return out.join(capacity.select("site_id", "max_containers"), "site_id", "left")


def weighted_level_stats(df: DataFrame, level: str, weight: str) -> DataFrame:
    """Container-weighted mean and population deviation of site levels, in one pass
    around a fixed centre (levels lie in 0-100, so squares stay exact enough)."""
    w, v = F.col(weight), F.col(level) - 50.0
    total = F.sum(w)
    mean = F.sum(w * v) / total
    variance = F.sum(w * v * v) / total - mean * mean
    return df.agg(
        F.when(total > 0, half_even(mean + 50.0, 2)).otherwise(F.lit(0.0)).alias("mean_fill_level"),
        F.when(total > 0, half_even(F.sqrt(F.greatest(F.lit(0.0), variance)), 2)).otherwise(F.lit(0.0)).alias("std_fill_level"),
    )


def donor_supply(metrics: DataFrame, config: ScoreConfig) -> DataFrame:
    """Containers each low-score site can give and stay under the safe fill, keeping one."""
    n, fill = F.col("container_count"), F.col("avg_fill_level")
    needed = F.greatest(F.lit(1), F.ceil(n * fill / config.safe_donor_fill))
    return (
        metrics.where((F.col("utilization_score") < config.min_utilization_donor) & (n > 1))
        .withColumn("supply", (n - needed).cast("bigint"))
        .where(F.col("supply") > 0)
    )


def receiver_demand(metrics: DataFrame, config: ScoreConfig) -> DataFrame:
    """Containers each high-score site wants, within its free curb capacity."""
    n, score = F.col("container_count"), F.col("utilization_score")
    wanted = F.when(n <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(n * (score / config.target_utilization - 1))))
    if config.apply_capacity:
        free = F.greatest(F.lit(0), F.col("max_containers") - n)
        wanted = F.when(F.col("max_containers").isNotNull(), F.least(wanted, free)).otherwise(wanted)
    return metrics.where(score >= config.min_utilization_receiver).withColumn("demand", wanted.cast("bigint")).where(F.col("demand") > 0)


def candidate_edges(supply: DataFrame, demand: DataFrame, config: ScoreConfig) -> DataFrame:
    """Compatible donor-receiver pairs within reach."""
    donors = supply.select(
        F.col("site_id").alias("donor_id"), F.col("latitude").alias("donor_latitude"), F.col("longitude").alias("donor_longitude"),
        "waste_type_id", "container_type_id",
    )
    receivers = demand.select(
        F.col("site_id").alias("receiver_id"), F.col("latitude").alias("receiver_latitude"), F.col("longitude").alias("receiver_longitude"),
        F.col("utilization_score").alias("score"), "waste_type_id", "container_type_id",
    )
    return spatial.haversine_pairs(donors, receivers, config.max_distance_km, ("waste_type_id", "container_type_id")).select(
        "donor_id", "receiver_id", "distance_km", "score"
    )


def greedy_moves(edges: DataFrame, supply: DataFrame, demand: DataFrame) -> DataFrame | None:
    """Most urgent receivers first, each from its nearest donors: amounts per pair.

    `supply` is (donor_id, supply), `demand` (receiver_id, demand). In each round every
    receiver takes from its nearest donors in order, as far as it is the most urgent open
    receiver of each: exactly the edges whose turn has come in the sequential order.
    """
    ranked = cut(edges.withColumn("urgency", F.struct((-F.col("score")).alias("s"), F.col("receiver_id").alias("r"))))
    chosen = Chosen()
    by_distance = Window.partitionBy("receiver_id").orderBy("distance_km", "donor_id")
    so_far = by_distance.rowsBetween(Window.unboundedPreceding, 0)
    earlier = by_distance.rowsBetween(Window.unboundedPreceding, -1)
    while True:
        taken = chosen.frame()
        open_edges = ranked.join(remaining(supply, taken, "donor_id", "supply"), "donor_id").join(
            remaining(demand, taken, "receiver_id", "demand"), "receiver_id"
        )
        first = open_edges.groupBy("donor_id").agg(F.min("urgency").alias("first"))
        turn = open_edges.join(first, "donor_id").withColumn("blocked", (F.col("urgency") != F.col("first")).cast("int"))
        turn = turn.withColumn("stop", F.max("blocked").over(so_far)).withColumn("before", F.coalesce(F.sum("supply").over(earlier), F.lit(0)))
        amount = F.least(F.col("supply"), F.col("demand") - F.col("before"))
        step = turn.where(F.col("stop") == 0).select("donor_id", "receiver_id", "distance_km", "score", amount.alias("amount"))
        if not chosen.add(step.where(F.col("amount") > 0)):
            return chosen.frame()


def assign_containers(moves: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row per moved container: the donor's emptiest ones go first, in plan order."""
    single = moves.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("amount"))).alias("nth")).drop("amount")
    order = Window.partitionBy("donor_id").orderBy(F.col("score").desc(), "receiver_id", "distance_km", "nth")
    numbered = single.withColumn("donor_rank", F.row_number().over(order)).drop("nth")
    pool = ranks.select(F.col("site_id").alias("donor_id"), "donor_rank", "container_id")
    return numbered.join(pool, ["donor_id", "donor_rank"])


def move_effects(moves: DataFrame, metrics: DataFrame) -> DataFrame:
    """Fill before and after of both sites for each single move."""
    d = metrics.select(F.col("site_id").alias("donor_id"), F.col("avg_fill_level").alias("df"), F.greatest(F.lit(1), F.col("container_count")).alias("dn"))
    r = metrics.select(F.col("site_id").alias("receiver_id"), F.col("avg_fill_level").alias("rf"), F.greatest(F.lit(1), F.col("container_count")).alias("rn"))
    rows = moves.join(small(d), "donor_id").join(small(r), "receiver_id")
    rows = (
        rows.withColumn("distance_km", half_even(F.col("distance_km"), 4))
        .withColumn("donor_fill_before", half_even(F.col("df"), 1))
        .withColumn("donor_fill_after", half_even(F.least(F.lit(100.0), F.col("df") * F.col("dn") / F.greatest(F.lit(1), F.col("dn") - 1)), 1))
        .withColumn("receiver_fill_before", half_even(F.col("rf"), 1))
        .withColumn("receiver_fill_after", half_even(F.least(F.lit(100.0), F.col("rf") * F.col("rn") / (F.col("rn") + 1)), 1))
    )
    delta = half_even(F.col("donor_fill_after") - F.col("donor_fill_before"), 1)
    relief = half_even(F.col("receiver_fill_after") - F.col("receiver_fill_before"), 1)
    return rows.withColumn("net_decongestion_pct", half_even(relief + delta, 1)).drop("df", "dn", "rf", "rn")


def plan_summary(moves: DataFrame, metrics: DataFrame, demand: DataFrame, config: ScoreConfig) -> DataFrame:
    """One row: moved, emptied, donors, receivers, distance, improvement and the
    container-weighted level before and after."""
    given = moves.groupBy(F.col("donor_id").alias("site_id")).agg(F.sum("amount").alias("given"))
    got = moves.groupBy(F.col("receiver_id").alias("site_id")).agg(F.sum("amount").alias("got"))
    after = (
        metrics.join(given, "site_id", "left")
        .join(got, "site_id", "left")
        .withColumn("given", F.coalesce("given", F.lit(0)))
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .withColumn("new_count", F.col("container_count") - F.col("given") + F.col("got"))
        .withColumn(
            "new_level",
            F.when(
                F.col("new_count") > 0,
                F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("avg_fill_level") * F.col("container_count") / F.col("new_count"))),
            ),
        )
    )
    totals = moves.agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("total_containers_moved"),
        F.count_distinct("receiver_id").alias("sites_receiving"),
        F.count_distinct("donor_id").alias("sites_donating"),
        F.coalesce(half_even(F.sum(F.col("amount") * half_even(F.col("distance_km"), 4)) / F.sum("amount"), 4), F.lit(0.0)).alias("avg_distance_km"),
    )
    emptied = after.agg(F.count_if((F.col("given") > 0) & (F.col("given") >= F.col("container_count"))).alias("sites_emptied"))
    wanted = demand.agg(F.coalesce(F.sum("demand"), F.lit(0)).alias("_wanted"))
    urgent = metrics.where(F.col("utilization_score") >= config.min_utilization_receiver).agg(F.avg("utilization_score").alias("_urgent"))
    before_stats = weighted_level_stats(metrics, "avg_fill_level", "container_count").toDF("original_mean_fill", "original_std_fill")
    after_stats = weighted_level_stats(after.where("new_count > 0"), "new_level", "new_count").toDF("optimized_mean_fill", "optimized_std_fill")
    row = totals
    for more in (emptied, wanted, urgent, before_stats, after_stats):
        row = attach(row, more)
    gain = F.coalesce("_urgent", F.lit(0.0)) * F.col("total_containers_moved") / F.greatest(F.col("_wanted"), F.lit(1))
    return row.withColumn("expected_improvement", half_even(F.least(gain, F.lit(1.0)), 4)).drop("_wanted", "_urgent")


def score_plan(metrics: DataFrame, config: ScoreConfig) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Moves (or none), the supply and the demand they were drawn from."""
    metrics = cut(metrics)
    supply, demand = donor_supply(metrics, config), receiver_demand(metrics, config)
    edges = candidate_edges(supply, demand, config)
    moves = greedy_moves(
        edges, cut(supply.select(F.col("site_id").alias("donor_id"), "supply")), cut(demand.select(F.col("site_id").alias("receiver_id"), "demand"))
    )
    return moves, supply, demand
