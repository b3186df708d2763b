"""Site level series: carry-forward buckets, collections, cycles, generation.

Raw readings are reduced to one row per (container, bucket) before anything else, so
a site or container holding a large share of all readings costs one partial
aggregate per task. Windows run over buckets only: a site has at most one row per
interval of the time span, however many readings it produced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.functions import times
from binflow.functions.numbers import half_even, half_up
from binflow.session import small

# Minutes a silent container keeps its last level; drops that count as
# a collection and as a full one.
MAX_CARRY_MINUTES = 180
PARTIAL_DROP = 10.0
STRONG_DROP = 25.0


def site_samples(readings: DataFrame, containers: DataFrame, start: Column, end: Column) -> DataFrame:
    """Readings of active containers in [start, end], under their current site. When the
    fact table carries its partition day, that column is filtered too and prunes files."""
    r = readings.drop("site_id").where(F.col("level").isNotNull() & F.col("reading_date").between(start, end))
    if "reading_day" in readings.columns:
        r = r.where(F.col("reading_day").between(F.to_date(start), F.to_date(end)))
    homes = containers.where(F.col("deleted_at").isNull() & F.col("site_id").isNotNull()).select(
        F.col("id").alias("container_id"), "site_id"
    )
    return r.join(small(homes), "container_id").select(
        "id", "site_id", "container_id", F.col("reading_date").alias("timestamp"), F.col("level").cast("double").alias("level"), "collected"
    )


def _stamps_served(bucket: Column, interval: int, carry: int) -> Column:
    """Grid points from `bucket` to `bucket + carry` minutes."""
    if 1440 % interval == 0:
        steps = F.sequence(F.lit(0), F.lit(carry // interval))
        return F.transform(steps, lambda k: times.plus_minutes(bucket, k * interval))
    # The grid restarts at midnight: lay it out day by day.
    days = F.sequence(F.to_date(bucket), F.to_date(times.plus_minutes(bucket, carry)))
    per_day = F.transform(
        days,
        lambda d: F.transform(
            F.sequence(F.lit(0), F.lit((1440 - 1) // interval)), lambda k: times.plus_minutes(d.cast(times.NTZ), k * interval)
        ),
    )
    return F.filter(F.flatten(per_day), lambda s: (s >= bucket) & (s <= times.plus_minutes(bucket, carry)))


def site_buckets(samples: DataFrame, interval: int = 60, how: str = "avg", carry: int = MAX_CARRY_MINUTES) -> DataFrame:
    """Bucket series per site where silent containers keep their last level for `carry`
    minutes; a bucket exists only where some container reported.

    Each (container, bucket) measurement is laid on the stamps it may serve; per stamp
    the newest one wins. Stamps without an own measurement fall away at the end, so no
    join against the site's buckets is needed.
    """
    measured = (
        samples.withColumn("bucket", times.floor_to_interval(F.col("timestamp"), interval))
        .groupBy("site_id", "container_id", "bucket")
        .agg(
            F.max_by("level", F.struct("timestamp", "id")).alias("level"),
            F.count("*").alias("n"),
            F.bool_or("collected").alias("collected"),
        )
    )
    served = measured.select("*", F.explode(_stamps_served(F.col("bucket"), interval, carry)).alias("stamp"))
    own = F.col("stamp") == F.col("bucket")
    latest = served.groupBy("site_id", "container_id", "stamp").agg(
        F.max_by("level", "bucket").alias("level"),
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n"),
        F.bool_or(own & F.col("collected")).alias("collected"),
    )
    mean, top = half_even(F.avg("level"), 2), half_even(F.max("level"), 2)
    return (
        latest.groupBy("site_id", F.col("stamp").alias("timestamp"))
        .agg(
            mean.alias("avg_level"),
            top.alias("max_level"),
            half_even(F.min("level"), 2).alias("min_level"),
            F.sum("n").alias("measurement_count"),
            F.count("*").alias("container_count"),
            F.bool_or("collected").alias("collected"),
        )
        .where(F.col("measurement_count") > 0)
        .withColumn("level", F.col("max_level" if how == "max" else "avg_level"))
    )


def hourly_levels(samples: DataFrame) -> DataFrame:
    """Mean level and collection flag per site and hour, without carry."""
    return samples.groupBy("site_id", F.date_trunc("hour", "timestamp").cast(times.NTZ).alias("timestamp")).agg(
        F.avg("level").alias("level"), F.bool_or("collected").alias("collected")
    )


def as_arrays(buckets: DataFrame) -> DataFrame:
    """One row per site with its ordered series; its length is bounded by the hours of
    the window, not by the readings."""
    series = F.array_sort(F.collect_list(F.struct("timestamp", "level", "collected")))
    return (
        buckets.groupBy("site_id")
        .agg(series.alias("s"))
        .select("site_id", F.col("s.level").alias("levels"), F.col("s.collected").alias("collected"))
    )


def _by_time(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("timestamp")


def _drop(previous: Column, level: Column) -> Column:
    return half_even(F.greatest(F.lit(0.0), previous - level), 2)


def with_events(buckets: DataFrame, keys: Sequence[str] = ("site_id",), partial: float = PARTIAL_DROP, strong: float = STRONG_DROP) -> DataFrame:
    """Adds previous_level, drop_points, is_event, reason and is_partial per bucket."""
    previous = F.lag("level").over(_by_time(keys))
    return (
        buckets.withColumn("previous_level", previous)
        .withColumn("drop_points", F.when(F.col("previous_level").isNotNull(), _drop(F.col("previous_level"), F.col("level"))))
        .withColumn("is_event", F.col("collected") | (F.coalesce("drop_points", F.lit(0.0)) >= partial))
        .withColumn("reason", F.when(F.col("collected"), "garbage_collection_alarm").when(F.col("is_event"), "level_drop"))
        .withColumn("is_partial", F.col("is_event") & F.coalesce(F.col("drop_points") < strong, F.lit(False)))
    )


def collection_cycles(buckets: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Cycles between collections; the event bucket ends one cycle and starts the next.
    The last cycle stays open."""
    k = list(keys)
    seen = F.sum(F.col("is_event").cast("int")).over(_by_time(keys).rowsBetween(Window.unboundedPreceding, 0))
    rows = with_events(buckets, keys).withColumn("cycle", seen)
    roles = F.when(
        F.col("is_event"),
        F.array(
            F.struct(F.col("cycle").alias("cycle"), F.lit(False).alias("closes")),
            F.struct((F.col("cycle") - 1).alias("cycle"), F.lit(True).alias("closes")),
        ),
    ).otherwise(F.array(F.struct(F.col("cycle").alias("cycle"), F.lit(False).alias("closes"))))
    member = rows.select(*k, "timestamp", "level", "reason", "drop_points", "is_partial", F.explode(roles).alias("r"))
    closing = F.col("r.closes")
    return (
        member.groupBy(*k, F.col("r.cycle").alias("cycle"))
        .agg(
            F.min("timestamp").alias("started_at"),
            F.max(F.when(closing, F.col("timestamp"))).alias("ended_at"),
            F.min_by("level", "timestamp").alias("start_level"),
            F.max_by("level", "timestamp").alias("end_level"),
            F.count("*").alias("bucket_count"),
            F.max(F.when(closing, F.col("reason"))).alias("reason"),
            F.max(F.when(closing, F.col("drop_points"))).alias("drop_points"),
            F.bool_or(closing & F.col("is_partial")).alias("is_partial"),
        )
        .withColumn("duration_hours", half_even(times.hours_between(F.col("started_at"), F.col("ended_at")), 2))
    )


def rises(buckets: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Adds `rise` from the previous bucket (null on the first) and `emptied`: a
    collection or any decrease, where generation cannot be read."""
    rows = with_events(buckets, keys)
    return rows.withColumn("rise", half_even(F.col("level") - F.col("previous_level"), 4)).withColumn(
        "emptied", F.col("is_event") | F.coalesce(F.col("level") < F.col("previous_level"), F.lit(False))
    )


def typical_increments(rise_rows: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Median rise per hour of day (as a map) and overall, from `rises` rows. Rises have
    four decimals within 0-100, so the exact median keeps few distinct values."""
    k = list(keys)
    hour = F.hour("timestamp")
    # Each rise counts under its hour and under all (-1): one pass, one shuffle.
    usable = rise_rows.where(F.col("rise").isNotNull() & ~F.col("emptied")).select(
        *k, "rise", F.explode(F.array(hour, F.lit(-1))).alias("hour")
    )
    medians = usable.groupBy(*k, "hour").agg(F.median("rise").alias("m"))
    entry = F.struct("hour", "m")
    return medians.groupBy(*k).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("hour") >= 0, entry))).alias("by_hour"),
        F.max(F.when(F.col("hour") == -1, F.col("m"))).alias("overall"),
    )


def _generation(rise_rows: DataFrame, typical: DataFrame, keys: Sequence[str]) -> DataFrame:
    fallback = F.coalesce(F.col("by_hour")[F.hour("timestamp")], F.col("overall"), F.lit(0.0))
    return (
        rise_rows.join(typical, list(keys), "left")
        .withColumn("generation", F.when(F.col("previous_level").isNull(), F.lit(0.0)).when(F.col("emptied"), fallback).otherwise(F.col("rise")))
        .drop("by_hour", "overall")
    )


def generation(buckets: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """What each bucket added; zero on the first, the hour's typical rise on collections."""
    rows = rises(buckets, keys)
    return _generation(rows, typical_increments(rows, keys), keys).withColumn("generation", half_even(F.col("generation"), 4))


def uncollected_levels(buckets: DataFrame, keys: Sequence[str] = ("site_id",), observed: str = "observed") -> DataFrame:
    """Level the site would have had without collections after the training part.

    `buckets` holds training rows and rows flagged `observed`, all later. Output: one row
    per observed bucket with start_level (last training level), level_before and
    uncollected. Keys lacking either part give no rows.
    """
    rows = rises(buckets, keys)
    typical = typical_increments(rows.where(~F.col(observed)), keys)
    later = F.col(observed)
    span = Window.partitionBy(*keys).orderBy("timestamp")
    grown = F.sum(F.when(later, F.col("generation")).otherwise(0.0)).over(span.rowsBetween(Window.unboundedPreceding, 0))
    start = F.max_by(F.when(~later, F.col("level")), F.when(~later, F.col("timestamp"))).over(Window.partitionBy(*keys))
    return (
        _generation(rows, typical, keys)
        .withColumn("start_level", start)
        .withColumn("uncollected", F.col("start_level") + grown)
        .where(later & F.col("start_level").isNotNull())
        .withColumn("level_before", F.coalesce(F.lag("uncollected").over(span), F.col("start_level")))
    )


def first_crossing(levels: DataFrame, threshold: float, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """First observed time at or above the threshold, before or after the step."""
    hit = (F.col("level_before") >= threshold) | (F.col("uncollected") >= threshold)
    return levels.groupBy(*keys).agg(F.min(F.when(hit, F.col("timestamp"))).alias("crossed_at"))


def increment_profile(buckets: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """One row per key: positive non-collection increments summarised by (weekday, hour),
    hour and overall, each with its count, plus the number of buckets."""
    k = list(keys)
    rows = rises(buckets, keys)
    usable = ~F.col("is_event") & F.coalesce(F.col("rise") > 0, F.lit(False))
    # Every bucket counts under "all"; a usable rise also under its hour and weekly slot.
    level = F.struct(F.lit("all").alias("kind"), F.lit(0).alias("at"))
    hour = F.struct(F.lit("hourly").alias("kind"), F.hour("timestamp").alias("at"))
    slot = F.struct(F.lit("weekly").alias("kind"), (F.weekday("timestamp") * 24 + F.hour("timestamp")).alias("at"))
    spread = rows.select(
        *k, F.when(usable, F.col("rise")).alias("rise"), F.explode(F.when(usable, F.array(level, hour, slot)).otherwise(F.array(level))).alias("g")
    )
    cells = spread.groupBy(*k, "g.kind", "g.at").agg(F.median("rise").alias("m"), F.count("rise").alias("n"), F.count("*").alias("total"))
    entry = F.struct(F.col("at"), F.struct("m", "n").alias("v"))

    def kind(name: str, value: Column) -> Column:
        return F.when(F.col("kind") == name, value)

    return cells.groupBy(*k).agg(
        F.max(kind("all", F.col("total"))).alias("bucket_count"),
        F.max(kind("all", F.col("m"))).alias("overall"),
        F.coalesce(F.max(kind("all", F.col("n"))), F.lit(0).cast("bigint")).alias("increments"),
        F.map_from_entries(F.collect_list(kind("weekly", entry))).alias("weekly"),
        F.map_from_entries(F.collect_list(kind("hourly", entry))).alias("hourly"),
    )


def time_bounds(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("level").isNotNull()).agg(
        F.min("reading_date").alias("earliest"), F.max("reading_date").alias("latest")
    )


def site_snapshots(sites: DataFrame, containers: DataFrame, types: DataFrame, level_rows: DataFrame, how: str = "avg") -> DataFrame:
    """Level and volume of each active site from the latest level per container.

    A site is complete when it has containers and each has a level; its volume is known
    when each has a positive volume. Levels clamp to 0-100 for the volume only.
    """
    alive = containers.where(F.col("deleted_at").isNull()).select(F.col("id").alias("container_id"), "site_id", "container_type_id")
    volumes = types.select(F.col("id").alias("container_type_id"), "volume_m3")
    filled = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("level").cast("double"))) * F.col("volume_m3") / 100
    rolled = (
        alive.join(level_rows.select("container_id", "level"), "container_id", "left")
        .join(small(volumes), "container_type_id", "left")
        .groupBy("site_id")
        .agg(
            F.bool_and(F.col("level").isNotNull()).alias("complete"),
            F.bool_or(F.coalesce(F.col("volume_m3") <= 0, F.lit(True))).alias("no_volume"),
            (F.max("level").cast("double") if how == "max" else half_even(F.avg("level"), 2)).alias("level"),
            half_even(F.sum(filled), 3).alias("volume"),
            half_even(F.sum("volume_m3"), 3).alias("capacity"),
        )
    )
    known = F.col("complete") & ~F.col("no_volume")
    return (
        sites.where(F.col("deleted_at").isNull())
        .select(F.col("id").alias("site_id"))
        .join(rolled, "site_id", "left")
        .select(
            "site_id",
            F.coalesce("complete", F.lit(False)).alias("complete"),
            F.when(F.col("complete"), F.col("level")).alias("level"),
            F.when(known, F.col("volume")).alias("current_volume_m3"),
            F.when(known, F.col("capacity")).alias("capacity_m3"),
        )
    )


def current_site_levels(sites: DataFrame, containers: DataFrame, how: str = "avg") -> DataFrame:
    """Level of each active site from the containers' current state; zero when empty."""
    alive = containers.where(F.col("deleted_at").isNull())
    level = F.max("current_level").cast("double") if how == "max" else half_up(F.avg("current_level"), 2)
    rolled = alive.groupBy("site_id").agg(level.alias("current_level"))
    return (
        sites.where(F.col("deleted_at").isNull())
        .select(F.col("id").alias("site_id"))
        .join(rolled, "site_id", "left")
        .withColumn("current_level", F.coalesce("current_level", F.lit(0.0)))
    )
