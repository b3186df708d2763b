"""The what-if network: the plan's distribution fed by the real readings.

A reading in real site S is waste that arrived at S. With the plan, S holds the containers
that stay (K) and those that arrive (A); the reading's rise is shared over them. The
replay is three steps: the sensors' own series, the shares as events of virtual
containers, and the virtual levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.functions import times
from binflow.functions.numbers import half_even
from binflow.operators import network
from binflow.operators.readings import with_previous
from binflow.plans.scan import Family, scanned, time_block
from binflow.session import attach, cut, small

# Weight of the newest rate, saturation and full levels, minutes between
# two counts of the network.
RATE_SMOOTHING = 0.3
SATURATION_LEVEL, FULL_LEVEL = 99.5, 100.0
TRACKING_MINUTES = 5

STATE_COLUMNS = (
    "container_id", "original_site_id", "optimized_site_id", "level", "last_reading",
    "virtual_updated_at", "rate_ewma", "overflow_hours", "real_overflow_hours",
)


def activate(containers: DataFrame, moves: DataFrame) -> DataFrame:
    """Virtual state at activation: every active container at its site and level, moved
    ones at the receiver and empty. `moves` is (container_id, to_site_id)."""
    to = moves.select("container_id", "to_site_id")
    return (
        containers.where(F.col("deleted_at").isNull())
        .withColumnRenamed("id", "container_id")
        .join(to, "container_id", "left")
        .select(
            "container_id",
            F.col("site_id").alias("original_site_id"),
            F.coalesce("to_site_id", "site_id").alias("optimized_site_id"),
            F.when(F.col("to_site_id").isNotNull(), F.lit(0.0)).otherwise(F.col("current_level").cast("double")).alias("level"),
            "last_reading",
            F.col("last_reading").alias("virtual_updated_at"),
            F.lit(None).cast("double").alias("rate_ewma"),
            F.lit(0.0).alias("overflow_hours"),
            F.lit(0.0).alias("real_overflow_hours"),
        )
    )


def reset(state: DataFrame) -> DataFrame:
    """Zero levels and counters; the distribution of the plan stays."""
    return state.select(
        "container_id", "original_site_id", "optimized_site_id", F.lit(0.0).alias("level"),
        F.lit(None).cast(times.NTZ).alias("last_reading"), F.lit(None).cast(times.NTZ).alias("virtual_updated_at"),
        F.lit(None).cast("double").alias("rate_ewma"), F.lit(0.0).alias("overflow_hours"), F.lit(0.0).alias("real_overflow_hours"),
    )


def overlay(containers: DataFrame, state: DataFrame) -> DataFrame:
    """Active containers under the plan: virtual site and level where a row exists."""
    v = state.select("container_id", "optimized_site_id", F.col("level").alias("virtual_level"))
    return (
        containers.where(F.col("deleted_at").isNull())
        .join(v, F.col("id") == F.col("container_id"), "left")
        .select(
            "id",
            F.coalesce("optimized_site_id", "site_id").alias("site_id"),
            F.coalesce("virtual_level", F.col("current_level").cast("double")).alias("level"),
        )
    )


def kpi_comparison(sites: DataFrame, containers: DataFrame, state: DataFrame) -> DataFrame:
    real = containers.where(F.col("deleted_at").isNull()).select("id", "site_id", F.col("current_level").cast("double").alias("level"))
    planned = overlay(containers, state)
    return network.compare_kpis(
        network.network_kpis(network.site_levels(sites, real, "level")), network.network_kpis(network.site_levels(sites, planned, "level"))
    )


def overflow_share(before: Column, after: Column, elapsed: Column) -> Column:
    """Hours at 100 % of an interval in which the level went from before to after."""
    crossing = elapsed * (after - FULL_LEVEL) / (after - before)
    return (
        F.when((elapsed <= 0) | (after < FULL_LEVEL), F.lit(0.0)).when(before >= FULL_LEVEL, elapsed).otherwise(crossing)
    )


def _compose_rates(g: Column, f: Column) -> list[Column]:
    alone = F.when(g["alone"].isNull(), f["alone"]).otherwise(f["a"] * g["alone"] + f["b"])
    return [alone, f["a"] * g["a"], f["a"] * g["b"] + f["b"]]


#: A sensor's smoothed fill rate: a * rate + b, or `alone` where there is no rate yet.
RATES = Family(
    ("alone", "a", "b"),
    _compose_rates,
    lambda f, rate: F.when(rate.isNull(), f["alone"]).otherwise(f["a"] * rate + f["b"]),
)


def rate_function(rate: Column) -> Column:
    """What a reading's rate does to the smoothed one; nothing where it is null."""
    known = rate.isNotNull()
    return RATES.of([rate, F.when(known, F.lit(1 - RATE_SMOOTHING)).otherwise(1.0), F.when(known, rate * RATE_SMOOTHING).otherwise(0.0)])


def _bounded(x: Column, f: Column) -> Column:
    return F.least(f["high"], F.greatest(f["low"], x + f["add"]))


#: A virtual container's level: shifted, then held between two bounds.
LEVELS = Family(
    ("add", "low", "high"),
    lambda g, f: [g["add"] + f["add"], _bounded(g["low"], f), _bounded(g["high"], f)],
    lambda f, level: _bounded(level, f),
)


def level_function(is_set: Column, amount: Column) -> Column:
    """What an event does to a level: set it, or shift it within 0 and FULL_LEVEL."""
    value = F.least(F.lit(FULL_LEVEL), F.greatest(F.lit(0.0), amount))
    bound = lambda free: F.when(is_set, value).otherwise(F.lit(free))
    return LEVELS.of([F.when(is_set, F.lit(0.0)).otherwise(amount), bound(0.0), bound(FULL_LEVEL)])


def _with_newcomers(state: DataFrame, readings: DataFrame, homes: DataFrame) -> DataFrame:
    """Containers read for the first time join at their site with their level before."""
    first = readings.groupBy("container_id").agg(F.min_by("level_before", "seq").alias("level_before"))
    new = (
        first.join(state.select("container_id"), "container_id", "left_anti")
        .join(homes.where(F.col("site_id").isNotNull()).select(F.col("id").alias("container_id"), "site_id"), "container_id")
        .select(
            "container_id", F.col("site_id").alias("original_site_id"), F.col("site_id").alias("optimized_site_id"),
            F.coalesce(F.col("level_before").cast("double"), F.lit(0.0)).alias("level"),
            F.lit(None).cast(times.NTZ).alias("last_reading"), F.lit(None).cast(times.NTZ).alias("virtual_updated_at"),
            F.lit(None).cast("double").alias("rate_ewma"), F.lit(0.0).alias("overflow_hours"), F.lit(0.0).alias("real_overflow_hours"),
        )
    )
    return state.select(*STATE_COLUMNS).unionByName(new)


def sensor_series(state: DataFrame, readings: DataFrame, block_hours: int = 168) -> DataFrame:
    """Per reading what really arrived: the rise, or the recent rate once the sensor
    saturates; plus real overflow hours and the smoothed rate."""
    known = state.select("container_id", "last_reading", "rate_ewma")
    rows = readings.join(known, "container_id").withColumn("at", times.epoch_micros(F.col("reading_date")))
    rows = with_previous(rows.withColumn("block", time_block("at", block_hours)), "container_id", ["reading_date", "seq"], F.col("block"), {"reading_date": "previous_date"})
    previous = F.coalesce("previous_date", "last_reading")
    elapsed = F.coalesce(F.greatest(F.lit(0.0), times.hours_between(previous, F.col("reading_date"))), F.lit(0.0))
    before, after = F.col("level_before").cast("double"), F.col("level_after").cast("double")
    rows = rows.withColumn("elapsed", elapsed)
    valid = ~F.col("collected") & before.isNotNull() & (after < SATURATION_LEVEL) & (F.col("elapsed") > 0)
    rows = rows.withColumn("rate", F.when(valid, F.greatest(after - before, F.lit(0.0)) / F.col("elapsed")))
    rows = scanned(rows, "container_id", ("at", "seq"), "block", RATES, rate_function(F.col("rate"))).where(F.col("seq").isNotNull())
    rows = rows.withColumns({"rate_before": RATES.after("before", F.col("rate_ewma")), "rate_after": RATES.after("until", F.col("rate_ewma"))})
    observed = after - before
    censored = (after >= SATURATION_LEVEL) & F.col("rate_before").isNotNull()
    generated = (
        F.when(before.isNull(), F.lit(0.0))
        .when(censored, F.greatest(observed, F.col("rate_before") * F.col("elapsed")))
        .otherwise(observed)
    )
    real = (
        F.when(before.isNotNull() & ~F.col("collected"), overflow_share(before, before + F.col("generated"), F.col("elapsed")))
        .when(before >= SATURATION_LEVEL, F.col("elapsed"))
        .otherwise(F.lit(0.0))
    )
    return (
        rows.withColumn("generated", generated)
        .withColumn("real_full_hours", real)
        .select("container_id", "seq", "reading_date", "at", "level_after", "collected", "generated", "real_full_hours", "rate_after")
    )


def virtual_events(state: DataFrame, series: DataFrame) -> DataFrame:
    """What each reading does to the virtual containers of its real site."""
    s = state.select("container_id", F.col("original_site_id").alias("site"), F.col("optimized_site_id").alias("target"))
    stays = F.col("site").eqNullSafe(F.col("target"))
    members = s.withColumn("stays", stays).withColumn("place", F.when(F.col("stays"), F.col("site")).otherwise(F.col("target")))
    counts = members.groupBy("place").agg(F.count_if("stays").alias("k"), F.count_if(~F.col("stays")).alias("a"))
    r = (
        series.join(small(members.select("container_id", "site", "stays")), "container_id")
        .join(small(counts), F.col("site") == F.col("place"), "left")
        .withColumn("k", F.coalesce("k", F.lit(0)))
        .withColumn("a", F.coalesce("a", F.lit(0)))
    )
    shares = F.col("k") + F.col("a")
    own = r.where("stays").select(
        "container_id", "at", "seq", F.col("collected").alias("is_set"),
        F.when(F.col("collected"), F.col("level_after").cast("double")).otherwise(F.col("generated") * F.col("k") / shares).alias("amount"),
    )
    arrivals = members.where(~F.col("stays")).select(F.col("place").alias("site"), F.col("container_id").alias("virtual_id"))
    passed = (
        r.where(F.col("stays") & (F.col("a") > 0))
        .join(small(arrivals), "site")
        .select(
            F.col("virtual_id").alias("container_id"), "at", "seq", F.col("collected").alias("is_set"),
            F.when(F.col("collected"), F.lit(0.0)).otherwise(F.col("generated") / shares).alias("amount"),
        )
    )
    keepers = members.where("stays").select("site", F.col("container_id").alias("virtual_id"))
    left = (
        r.where(~F.col("stays") & ~F.col("collected") & (F.col("k") > 0))
        .join(small(keepers), "site")
        .select(F.col("virtual_id").alias("container_id"), "at", "seq", F.lit(False).alias("is_set"), (F.col("generated") / F.col("k")).alias("amount"))
    )
    return own.unionByName(passed).unionByName(left)


def level_changes(state: DataFrame, events: DataFrame, block_hours: int = 168) -> DataFrame:
    """(container_id, at, seq, new_level, full_hours): the level after each event, and the hours at
    100 % since the event before."""
    rows = cut(events.withColumn("block", time_block("at", block_hours)))
    known = state.select("container_id", "level", times.epoch_micros(F.col("virtual_updated_at")).alias("updated"))
    rows = with_previous(rows, "container_id", ["at", "seq"], F.col("block"), {"at": "previous_at"})
    moved = scanned(rows, "container_id", ("at", "seq"), "block", LEVELS, level_function(F.col("is_set"), F.col("amount"))).join(known, "container_id")
    start = F.coalesce("level", F.lit(0.0))
    moved = moved.withColumns({"level": LEVELS.after("before", start), "new_level": LEVELS.after("until", start)})
    elapsed = F.coalesce(F.greatest(F.lit(0.0), (F.col("at") - F.coalesce("previous_at", "updated")) / 3_600_000_000), F.lit(0.0))
    full = F.when(F.col("is_set"), F.when(F.col("level") >= FULL_LEVEL, elapsed).otherwise(0.0)).otherwise(
        overflow_share(F.col("level"), F.col("level") + F.col("amount"), elapsed)
    )
    return moved.select("container_id", "at", "seq", "new_level", full.alias("full_hours"))


def replay(state: DataFrame, readings: DataFrame, homes: DataFrame, block_hours: int = 168) -> DataFrame:
    """State after a batch of accepted readings.

    `readings`: container_id, seq (arrival), level_before, level_after, reading_date,
    collected. `homes`: containers with id and site_id.
    """
    # Each is read several times below; materialised once in the checkpoint folder.
    start = cut(_with_newcomers(state, readings, homes))
    series = cut(sensor_series(start, readings, block_hours))
    events = virtual_events(start, series)
    moved = level_changes(start, events, block_hours)
    levels = moved.groupBy("container_id").agg(
        F.max_by("new_level", F.struct("at", "seq")).alias("new_level"),
        F.max("at").alias("last_at"),
        F.sum("full_hours").alias("more_overflow"),
    )
    sensors = series.groupBy("container_id").agg(
        F.max("reading_date").alias("newest"),
        F.max_by("rate_after", F.struct("reading_date", "seq")).alias("new_rate"),
        F.sum("real_full_hours").alias("more_real"),
    )
    return (
        start.join(levels, "container_id", "left")
        .join(sensors, "container_id", "left")
        .select(
            "container_id", "original_site_id", "optimized_site_id",
            F.coalesce("new_level", "level").alias("level"),
            F.coalesce("newest", "last_reading").alias("last_reading"),
            F.coalesce(F.timestamp_micros("last_at").cast(times.NTZ), "virtual_updated_at").alias("virtual_updated_at"),
            F.coalesce("new_rate", "rate_ewma").alias("rate_ewma"),
            (F.col("overflow_hours") + F.coalesce("more_overflow", F.lit(0.0))).alias("overflow_hours"),
            (F.col("real_overflow_hours") + F.coalesce("more_real", F.lit(0.0))).alias("real_overflow_hours"),
        )
    )


COUNTS = ("real_critical_sites", "critical_sites", "real_full_containers", "full_containers")


def network_counts(sites: DataFrame, containers: DataFrame, state: DataFrame) -> DataFrame:
    """One row with the four counts of the real and the planned network."""
    real = containers.where(F.col("deleted_at").isNull()).select("id", "site_id", F.col("current_level").cast("double").alias("level"))
    planned = overlay(containers, state)
    a = network.critical_and_full(network.site_levels(sites, real, "level"), real, "level").toDF("real_critical_sites", "real_full_containers")
    b = network.critical_and_full(network.site_levels(sites, planned, "level"), planned, "level")
    one = F.lit(1)
    return a.withColumn("one", one).join(b.withColumn("one", one), "one").select(*COUNTS)


def thin_counts(snapshots: DataFrame, minutes: int = TRACKING_MINUTES, block_hours: int = 24) -> DataFrame:
    """Snapshots kept per plan: the first, then each one at least `minutes` after the last kept;
    of equal times the first.

    Every snapshot has a successor, the first one at least `minutes` later. What is kept is what
    the first snapshot reaches, found by doubling: knowing the 2^k-th successor of each, what is
    reached within 2^k steps reaches as much again in one join. No task walks a plan.
    """
    rows = snapshots.withColumn("_at", times.epoch_micros(F.col("observed_at")))
    gap = minutes * 60_000_000
    jumps = cut(_successors(rows.select("plan_id", "_at").distinct(), gap, block_hours))
    reached = cut(jumps.groupBy("plan_id").agg(F.min("_at").alias("_at")))
    while not jumps.where("next IS NOT NULL").isEmpty():
        onward = reached.join(jumps, ["plan_id", "_at"]).where("next IS NOT NULL").select("plan_id", F.col("next").alias("_at"))
        reached = cut(reached.unionByName(onward).distinct())
        further = jumps.select("plan_id", F.col("_at").alias("next"), F.col("next").alias("after"))
        jumps = cut(jumps.where("next IS NOT NULL").join(further, ["plan_id", "next"], "left").select("plan_id", "_at", F.col("after").alias("next")))
    kept = rows.join(reached, ["plan_id", "_at"])
    columns = snapshots.columns
    return kept.groupBy("plan_id", "_at").agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")


def _successors(times_of: DataFrame, gap: int, block_hours: int) -> DataFrame:
    """(plan_id, _at, next): the first time at least `gap` micros later, null without one.

    Each time asks at `_at + gap`; questions and times run together through blocks of time, and
    what a block doesn't answer the next block's first time does.
    """
    span = 3_600_000_000 * block_hours
    asked = times_of.select("plan_id", "_at", (F.col("_at") + gap).alias("t"), F.lit(None).cast("bigint").alias("here"))
    there = times_of.select("plan_id", F.lit(None).cast("bigint").alias("_at"), F.col("_at").alias("t"), F.col("_at").alias("here"))
    both = asked.unionByName(there).withColumn("block", F.floor(F.col("t") / span))
    # Latest first; at one instant the time itself answers the question.
    ahead = Window.partitionBy("plan_id", "block").orderBy(F.desc("t"), F.col("here").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("next", F.last("here", ignorenulls=True).over(ahead)).where("_at IS NOT NULL")
    blocks = both.groupBy("plan_id", "block").agg(F.min("here").alias("least"))
    later = Window.partitionBy("plan_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("plan_id", "block", F.last("least", ignorenulls=True).over(later).alias("least"))
    return inside.join(blocks, ["plan_id", "block"]).select("plan_id", "_at", F.coalesce("next", "least").alias("next"))


def tracked_totals(kept: DataFrame) -> DataFrame:
    """Each kept count holds until the next one: hour-weighted sums per plan."""
    after = F.lead("observed_at").over(Window.partitionBy("plan_id").orderBy("observed_at"))
    hours = F.coalesce(times.hours_between(F.col("observed_at"), F.col("after")), F.lit(0.0))
    rows = kept.withColumn("after", after).withColumn("hours", hours)
    return rows.groupBy("plan_id").agg(
        F.sum("hours").alias("observed_hours"), *[F.sum(F.col(c) * F.col("hours")).alias(f"{c}_hours") for c in COUNTS]
    )


def comparison(totals: DataFrame, state: DataFrame, counts: DataFrame) -> DataFrame:
    """Real against plan: time averages, hours at 100 %, and the network now."""
    spent = state.agg(
        half_even(F.coalesce(F.sum("real_overflow_hours"), F.lit(0.0)), 1).alias("real_full_hours"),
        half_even(F.coalesce(F.sum("overflow_hours"), F.lit(0.0)), 1).alias("plan_full_hours"),
    )
    rows = attach(attach(totals, spent), counts)
    averages = [
        F.when(F.col("observed_hours") > 0, half_even(F.col(f"{c}_hours") / F.col("observed_hours"), 1)).alias(f"avg_{c}") for c in COUNTS
    ]
    return rows.select(
        "plan_id", half_even(F.col("observed_hours"), 2).alias("observed_hours"), *averages, "real_full_hours", "plan_full_hours",
        *[F.col(c).alias(f"{c}_now") for c in COUNTS],
    )
