"""The overload model: what a site would have suffered with other container counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.functions import times
from binflow.functions.numbers import half_even
from binflow.operators import history, network, spatial
from binflow.plans.rounds import Chosen
from binflow.plans.utilisation import weighted_level_stats
from binflow.session import attach, cut

# Saturation level, rises remembered while saturated, weight of one
# overflow hour, smallest gain.
SATURATION_LEVEL = 99.5
RECENT_RISES = 3
OVERFLOW_WEIGHT = 3.0
CRITICAL_LEVEL, FULL_LEVEL = 80.0, 100.0
MIN_GAIN = 1e-9


@dataclass(frozen=True)
class OverloadConfig:
    max_distance_km: float = 1.0
    move_cost_hours_per_week: float = 0.0
    window_days: int = 28

    @property
    def move_cost(self) -> float:
        return self.move_cost_hours_per_week * self.window_days / 7


def accumulated(levels: DataFrame, counts: DataFrame) -> DataFrame:
    """Waste since the last collection per bucket, in percent of one container.

    `levels` is (site_id, timestamp, level, collected), one row per bucket, and `counts`
    (site_id, containers). Saturated buckets rise by the mean of the last three free
    rises of their stretch.
    """
    by_time = Window.partitionBy("site_id").orderBy("timestamp")
    previous = F.lag("level").over(by_time)
    fall = half_even(F.greatest(F.lit(0.0), F.col("previous") - F.col("level")), 2)
    starts = F.col("previous").isNull() | F.col("collected") | (fall >= history.PARTIAL_DROP)
    rows = (
        levels.withColumn("previous", previous)
        .withColumn("starts", starts)
        .withColumn("stretch", F.sum(F.col("starts").cast("int")).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    )
    inside = Window.partitionBy("site_id", "stretch").orderBy("timestamp")
    saturated = (F.col("previous") >= SATURATION_LEVEL) & (F.col("level") >= SATURATION_LEVEL)
    rows = rows.withColumn("position", F.row_number().over(inside)).withColumn(
        "kind", F.when(F.col("starts"), "start").when(saturated & (F.col("position") >= 3), "held").otherwise("free")
    )
    memory = Window.partitionBy("site_id", "stretch", "kind").orderBy("timestamp").rowsBetween(1 - RECENT_RISES, 0)
    free_rise = F.greatest(F.lit(0.0), F.col("level") - F.col("previous"))
    rows = rows.withColumn("recent", F.when(F.col("kind") == "free", F.avg(free_rise).over(memory)))
    held_rise = F.last("recent", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rise = F.when(F.col("kind") == "free", free_rise).when(F.col("kind") == "held", held_rise).otherwise(F.col("level"))
    rows = rows.withColumn("rise", rise)
    total = F.sum("rise").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("total", total)
        .join(counts.select("site_id", "containers"), "site_id")
        .select("site_id", "timestamp", "level", "collected", "containers", (F.col("total") * F.col("containers")).alias("acc"))
    )


def _steps(acc: Column, level: float) -> Column:
    """Largest k with acc >= level * k, safe against a quotient rounded across a step."""
    k = F.floor(acc / level)
    return k + F.when(acc >= (k + 1) * level, 1).otherwise(0) - F.when(acc < k * level, 1).otherwise(0)


def overload_steps(acc: DataFrame, hours_per_bucket: float = 1.0) -> DataFrame:
    """Per site a histogram of how many containers each bucket would have filled to the
    critical and to the full level: all that any container count needs."""
    rows = acc.select(
        "site_id",
        "containers",
        F.explode(
            F.array(
                F.struct(F.lit("critical").alias("kind"), _steps(F.col("acc"), CRITICAL_LEVEL).alias("k")),
                F.struct(F.lit("full").alias("kind"), _steps(F.col("acc"), FULL_LEVEL).alias("k")),
            )
        ).alias("s"),
    ).select("site_id", "containers", "s.kind", "s.k")
    return rows.groupBy("site_id", "kind", "k").agg((F.count("*") * hours_per_bucket).alias("hours"), F.first("containers").alias("now"))


def overload_hours(steps: DataFrame, candidates: DataFrame) -> DataFrame:
    """Critical and overflow hours and cost for each (site_id, containers) candidate."""
    at = F.when(F.col("k") >= F.col("containers"), F.col("hours")).otherwise(0.0)
    sums = (
        candidates.select("site_id", "containers")
        .join(steps, "site_id")
        .groupBy("site_id", "containers")
        .agg(
            F.sum(F.when(F.col("kind") == "critical", at).otherwise(0.0)).alias("over"),
            F.sum(F.when(F.col("kind") == "full", at).otherwise(0.0)).alias("overflow_hours"),
        )
    )
    return sums.select(
        "site_id", "containers", (F.col("over") - F.col("overflow_hours")).alias("critical_hours"), "overflow_hours",
        (F.col("over") - F.col("overflow_hours") + OVERFLOW_WEIGHT * F.col("overflow_hours")).alias("cost"),
    )


def cost_curves(acc: DataFrame, hours_per_bucket: float = 1.0) -> DataFrame:
    """Per site its current count and the cost for 1, 2, ... containers as an array; from
    the end of the array on the cost is zero."""
    steps = cut(overload_steps(acc, hours_per_bucket))
    counts = steps.groupBy("site_id").agg(F.first("now").alias("now"))
    top = steps.groupBy("site_id").agg(F.max("k").alias("top"))
    wanted = counts.join(top, "site_id").select(
        "site_id", "now", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("now") + 1, F.col("top") + 1))).alias("containers")
    )
    costs = overload_hours(steps, wanted)
    return (
        wanted.join(costs, ["site_id", "containers"])
        .groupBy("site_id", "now")
        .agg(F.array_sort(F.collect_list(F.struct("containers", "cost"))).alias("c"))
        .select("site_id", "now", F.col("c.cost").alias("costs"))
    )


def cost_at(costs: Column, count: Column) -> Column:
    return F.coalesce(F.when(count >= 1, F.get(costs, (count - 1).cast("int"))), F.lit(0.0))


def candidates(sites: DataFrame, containers: DataFrame, readings: DataFrame, clock: Column, config: OverloadConfig, capacity: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sites that may take part in a plan and their hourly levels in the window.

    First frame: site_id, group_key, coordinates, containers, max_containers,
    average_level; second: site_id, timestamp, level, collected.
    """
    start = times.plus_minutes(clock, -1440 * config.window_days)
    rows = network.sites_of_interest(sites, containers, readings, start, clock, CRITICAL_LEVEL)
    types = containers.where(F.col("deleted_at").isNull()).groupBy("site_id").agg(F.min("container_type_id").alias("type_id"))
    samples = history.site_samples(readings, containers, start, clock)
    hourly = cut(history.hourly_levels(samples).join(rows.select("site_id"), "site_id", "left_semi"))
    means = hourly.groupBy("site_id").agg(F.avg("level").alias("average_level"))
    group = F.concat_ws("/", F.coalesce(F.col("waste_type_id").cast("string"), F.lit("-")), F.coalesce(F.col("type_id").cast("string"), F.lit("-")))
    chosen = rows.join(types, "site_id").join(means, "site_id").withColumn("group_key", group)
    if capacity is None:
        chosen = chosen.withColumn("max_containers", F.lit(None).cast("int"))
    else:
        chosen = chosen.join(capacity.select("site_id", "max_containers"), "site_id", "left")
    return (
        chosen.select("site_id", "name", "group_key", "latitude", "longitude", "containers", "max_containers", "average_level"),
        hourly,
    )


def greedy_moves(sites: DataFrame, curves: DataFrame, config: OverloadConfig) -> DataFrame | None:
    """Single-container moves by net marginal gain, in rounds of mutually best edges.

    `sites` has site_id, group_key, latitude, longitude, max_containers. The first move of
    a site fixes it as donor or receiver; receivers stay within capacity; donors keep one.
    """
    s = sites.join(curves, "site_id")
    free = F.col("max_containers").isNull() | (F.col("now") < F.col("max_containers"))
    states = cut(
        s.select(
            "site_id", "group_key", "latitude", "longitude", "max_containers", "now", "costs",
            (free & (cost_at(F.col("costs"), F.col("now")) > 0)).alias("can_receive"),
            (F.col("now") >= 2).alias("can_donate"),
        )
    )
    pairs = cut(spatial.planar_pairs(states, config.max_distance_km).select("group_key", "donor_id", "receiver_id", "distance_km"))
    chosen = Chosen()
    number = 0
    while True:
        taken = chosen.frame()
        live = states.select("site_id", "max_containers", "now", "costs")
        if taken is None:
            live = live.withColumn("given", F.lit(0)).withColumn("got", F.lit(0))
        else:
            change = (
                taken.select(F.explode(F.array(F.struct(F.col("donor_id").alias("site_id"), F.lit(1).alias("given"), F.lit(0).alias("got")), F.struct(F.col("receiver_id").alias("site_id"), F.lit(0).alias("given"), F.lit(1).alias("got")))).alias("m"))
                .select("m.*")
                .groupBy("site_id")
                .agg(F.sum("given").alias("given"), F.sum("got").alias("got"))
            )
            live = live.join(change, "site_id", "left").withColumn("given", F.coalesce("given", F.lit(0))).withColumn("got", F.coalesce("got", F.lit(0)))
        count = F.col("now") - F.col("given") + F.col("got")
        damage = cost_at(F.col("costs"), count - 1) - cost_at(F.col("costs"), count)
        relief = cost_at(F.col("costs"), count) - cost_at(F.col("costs"), count + 1)
        room = F.col("max_containers").isNull() | (count < F.col("max_containers"))
        donors = live.where((count > 1) & (F.col("got") == 0)).select(F.col("site_id").alias("donor_id"), damage.alias("damage"))
        receivers = live.where(room & (F.col("given") == 0)).select(F.col("site_id").alias("receiver_id"), relief.alias("relief"))
        open_edges = (
            pairs.join(donors, "donor_id")
            .join(receivers, "receiver_id")
            .withColumn("gain", F.col("relief") - F.col("damage"))
            .where(F.col("gain") > config.move_cost + MIN_GAIN)
            .withColumn("loss", -F.col("gain"))
        )
        rank = F.struct("loss", "distance_km", "donor_id", "receiver_id")
        edge = F.struct("group_key", "donor_id", "receiver_id", "distance_km", "gain")
        ends = open_edges.select(F.explode(F.array("donor_id", "receiver_id")).alias("site_id"), edge.alias("edge"), rank.alias("rank"))
        best = ends.groupBy("site_id").agg(F.min_by("edge", "rank").alias("edge"))
        mutual = best.groupBy("edge").agg(F.count("*").alias("ends")).where("ends = 2").select("edge.*")
        if not chosen.add(mutual.withColumn("round", F.lit(number))):
            break
        number += 1
    moves = chosen.frame()
    if moves is None:
        return None
    return moves.select(
        "group_key", "donor_id", "receiver_id", half_even(F.col("distance_km"), 4).alias("distance_km"),
        half_even(F.col("gain"), 4).alias("overload_reduction"), "round",
    )


def isotonic(values: Column, increasing: bool) -> Column:
    """Least-squares monotone fit of an array: one fold that keeps blocks of pooled values and
    pools the newest one with those before it while they are out of order."""
    block = "struct<total:double,n:int>"
    none = F.array().cast(f"array<{block}>")

    def mean(b: Column) -> Column:
        return b["total"] / b["n"]

    def pooled(blocks: Column, value: Column) -> Column:
        first = F.struct(value.cast("double").alias("total"), F.lit(1).alias("n"), F.lit(False).alias("done"), none.alias("kept"))

        def step(s: Column, b: Column) -> Column:
            apart = mean(b) <= mean(s) if increasing else mean(b) >= mean(s)
            stop = s["done"] | apart
            return F.struct(
                F.when(stop, s["total"]).otherwise(s["total"] + b["total"]).alias("total"), F.when(stop, s["n"]).otherwise(s["n"] + b["n"]).alias("n"),
                stop.alias("done"), F.when(stop, F.array_append(s["kept"], b)).otherwise(s["kept"]).alias("kept"),
            )

        # The newest block comes first in the list.
        return F.aggregate(blocks, first, step, lambda s: F.concat(F.array(F.struct(s["total"].alias("total"), s["n"].alias("n"))), s["kept"]))

    fitted = F.reverse(F.aggregate(values, none, pooled))
    return F.flatten(F.transform(fitted, lambda b: F.array_repeat(mean(b), b["n"])))


def marginal_curves(curves: DataFrame, limits: DataFrame, move_cost: float = 0.0) -> DataFrame:
    """Per site the gains of receiving and the damages of giving, one container after
    another, made monotone; gains end where they stop paying the move. Beyond the end of a
    cost curve a container saves nothing, so no gain lies there.

    `limits` is (site_id, max_containers).
    """
    rows = curves.join(limits.select("site_id", "max_containers"), "site_id")
    now, costs = F.col("now"), F.col("costs")
    useful = F.greatest(F.lit(0), F.size(costs) - now)
    extra = F.least(useful, F.coalesce(F.col("max_containers") - now, useful)).cast("int")
    none = F.array().cast("array<double>")

    def relief(count: Column) -> Column:
        return cost_at(costs, count) - cost_at(costs, count + 1)

    raw_gains = F.when(extra >= 1, F.transform(F.sequence(F.lit(1), extra), lambda k: relief(now + k - 1))).otherwise(none)
    raw_damages = F.when(now >= 2, F.transform(F.sequence(F.lit(1), (now - 1).cast("int")), lambda k: relief(now - k))).otherwise(none)
    fitted = rows.withColumn("raw_gains", raw_gains).withColumn("raw_damages", raw_damages)
    gains = isotonic(F.col("raw_gains"), increasing=False)
    return fitted.select(
        "site_id", "now", F.filter(gains, lambda g: g > move_cost + MIN_GAIN).alias("gains"), isotonic(F.col("raw_damages"), increasing=True).alias("damages")
    )


def useful_pairs(pairs: DataFrame, marginal: DataFrame, move_cost: float = 0.0) -> DataFrame:
    """Pairs whose first container pays: first damage plus the move is below the first gain."""
    g = marginal.where(F.size("gains") > 0).select(F.col("site_id").alias("receiver_id"), F.col("gains")[0].alias("first_gain"))
    d = marginal.where(F.size("damages") > 0).select(F.col("site_id").alias("donor_id"), F.col("damages")[0].alias("first_damage"))
    return (
        pairs.join(g, "receiver_id")
        .join(d, "donor_id")
        .where((F.col("donor_id") != F.col("receiver_id")) & (F.col("first_damage") + move_cost < F.col("first_gain") - MIN_GAIN))
    )


def merge_groups(moves: DataFrame) -> DataFrame:
    """Moves of all groups interleaved by reduction, order inside a group kept: sorted by
    the smallest reduction so far in the group, then group and position.

    The order inside a group is that of one move after another: larger reduction, shorter way,
    lower ids. For monotone cost curves the sequential planner takes its moves in it; the
    rounds in which they were found say nothing about it.
    """
    inside = Window.partitionBy("group_key").orderBy(F.col("overload_reduction").desc(), "distance_km", "donor_id", "receiver_id")
    return (
        moves.withColumn("position", F.row_number().over(inside))
        .withColumn("merge_key", F.min("overload_reduction").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .orderBy(F.col("merge_key").desc(), "group_key", "position")
    )


def cumulative_levels(moves: DataFrame, sites: DataFrame, order: list[str]) -> DataFrame:
    """Level of donor and receiver before and after each move, following earlier moves of
    the same site. `sites` has site_id, containers, average_level. A site whose moves leave
    it without a container is full."""

    def level(average: Column, start: Column, count: Column) -> Column:
        held = average * start
        spread = F.when(count != 0, held / count).when(held.isNotNull(), F.lit(100.0))
        return half_even(F.least(F.lit(100.0), spread), 1)

    rows = moves
    for end, sign in (("donor", -1), ("receiver", 1)):
        nth = F.row_number().over(Window.partitionBy(f"{end}_id").orderBy(*order))
        facts = sites.select(F.col("site_id").alias(f"{end}_id"), F.col("containers").alias("_n"), F.col("average_level").alias("_avg"))
        rows = rows.withColumn("_nth", nth).join(facts, f"{end}_id")
        before, after = F.col("_n") + sign * (F.col("_nth") - 1), F.col("_n") + sign * F.col("_nth")
        rows = (
            rows.withColumn(f"{end}_fill_before", level(F.col("_avg"), F.col("_n"), before))
            .withColumn(f"{end}_fill_after", level(F.col("_avg"), F.col("_n"), after))
        )
        if end == "donor":
            rows = rows.withColumn("donor_rank", F.col("_nth"))
        rows = rows.drop("_nth", "_n", "_avg")
    net = (F.col("receiver_fill_after") - F.col("receiver_fill_before")) + (F.col("donor_fill_after") - F.col("donor_fill_before"))
    return rows.withColumn("net_decongestion_pct", half_even(net, 1))


def assign_containers(moves: DataFrame, ranks: DataFrame) -> DataFrame:
    """The donor's emptiest remaining container for each move (needs donor_rank)."""
    pool = ranks.select(F.col("site_id").alias("donor_id"), "donor_rank", "container_id")
    return moves.join(pool, ["donor_id", "donor_rank"])


def plan_summary(moves: DataFrame, sites: DataFrame, steps: DataFrame) -> DataFrame:
    """One row over the candidate sites: hours before and after, levels, distances."""
    change = (
        moves.select(F.explode(F.array(F.struct(F.col("donor_id").alias("site_id"), F.lit(-1).alias("d")), F.struct(F.col("receiver_id").alias("site_id"), F.lit(1).alias("d")))).alias("m"))
        .select("m.*")
        .groupBy("site_id")
        .agg(F.sum("d").alias("d"))
    )
    s = sites.join(change, "site_id", "left").withColumn("final", F.col("containers") + F.coalesce("d", F.lit(0)))
    hours = overload_hours(steps, s.select("site_id", "containers").unionByName(s.select("site_id", F.col("final").alias("containers"))).distinct())
    h = hours.select("site_id", F.col("containers").alias("n"), "critical_hours", "overflow_hours")
    before = h.toDF("site_id", "containers", "cb", "ob")
    after = h.toDF("site_id", "final", "ca", "oa")
    sums = s.join(before, ["site_id", "containers"]).join(after, ["site_id", "final"]).agg(*[F.sum(c).alias(c) for c in ("cb", "ob", "ca", "oa")])

    def level(count: Column) -> Column:
        return half_even(F.least(F.lit(100.0), F.col("average_level") * F.col("containers") / count), 1)

    levels = s.withColumn("lb", level(F.col("containers"))).withColumn("la", level(F.col("final")))
    row = moves.agg(
        F.count("*").alias("total_containers_moved"), F.count_distinct("receiver_id").alias("sites_receiving"),
        F.count_distinct("donor_id").alias("sites_donating"), F.coalesce(half_even(F.avg("distance_km"), 4), F.lit(0.0)).alias("avg_distance_km"),
    ).withColumn("sites_emptied", F.lit(0))
    row = attach(row, weighted_level_stats(levels, "lb", "containers").toDF("original_mean_fill", "original_std_fill"))
    row = attach(row, weighted_level_stats(levels, "la", "final").toDF("optimized_mean_fill", "optimized_std_fill"))
    row = attach(row, sums)
    cost_before, cost_after = F.col("cb") + OVERFLOW_WEIGHT * F.col("ob"), F.col("ca") + OVERFLOW_WEIGHT * F.col("oa")
    return row.select(
        *[c for c in row.columns if c not in ("cb", "ob", "ca", "oa")],
        F.when(cost_before > 0, half_even((cost_before - cost_after) / cost_before, 4)).otherwise(F.lit(0.0)).alias("expected_improvement"),
        half_even(F.col("cb"), 1).alias("critical_hours_before"), half_even(F.col("ca"), 1).alias("critical_hours_after"),
        half_even(F.col("ob"), 1).alias("overflow_hours_before"), half_even(F.col("oa"), 1).alias("overflow_hours_after"),
    )
