"""Arrival-order rules, retention and sampling over raw readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Readings of one key handled by one window partition at most.
BLOCK_ROWS = 1_000_000


def accepted_readings(readings: DataFrame, sequence: str = "id", block_rows: int = BLOCK_ROWS, states: DataFrame | None = None) -> DataFrame:
    """Flags readings strictly newer than every earlier one of their container, in
    arrival order, and gives each the level accepted before it.

    The running maximum is taken in two steps, so one container with most of the rows
    spreads over many tasks: per block of arrival numbers, then across the few block
    maxima. Ties on the date keep the first arrival. `states` (container_id,
    current_level, last_reading) is what was accepted before this batch.
    """
    mark = F.struct(F.col("reading_date").alias("d"), (-F.col(sequence)).alias("s"), F.col("level").alias("l"))
    rows = readings.withColumn("block", F.floor(F.col(sequence) / block_rows)).withColumn("mark", mark)
    tops = rows.groupBy("container_id", "block").agg(F.max("mark").alias("top"))
    earlier = Window.partitionBy("container_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("carried", F.max("top").over(earlier)).drop("top")
    inside = Window.partitionBy("container_id", "block").orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.max("mark").over(inside), F.col("carried"))
    rows = rows.join(carried, ["container_id", "block"])
    if states is not None:
        start = F.struct(F.col("last_reading").alias("d"), F.lit(2**62).alias("s"), F.col("current_level").alias("l"))
        known = states.where(F.col("last_reading").isNotNull()).select("container_id", start.alias("start"))
        unread = states.where(F.col("last_reading").isNull()).select("container_id", F.col("current_level").alias("unread_level"))
        rows = rows.join(known, "container_id", "left").join(unread, "container_id", "left")
        best = F.greatest(best, F.col("start"))
    else:
        rows = rows.withColumn("start", F.lit(None)).withColumn("unread_level", F.lit(None).cast("int"))
    return (
        rows.withColumn("before", best)
        .withColumn("accepted", F.col("before").isNull() | (F.col("reading_date") > F.col("before.d")))
        .withColumn("level_old", F.coalesce("before.l", "unread_level"))
        .drop("mark", "block", "carried", "before", "start", "unread_level")
    )


def with_previous(rows: DataFrame, key: str, order: list[str], block: Column, columns: dict[str, str]) -> DataFrame:
    """Adds, for each `source: name` of `columns`, the value of the key's previous row.

    A plain lag would put a crowded key in one task: rows are ordered inside blocks (of
    time, rising with the order), and only the last row of each block is carried on.
    """
    names = list(columns)
    packed = F.struct(*names)
    blocked = rows.withColumn("_block", block)
    ends = blocked.groupBy(key, "_block").agg(F.max_by(packed, F.struct(*order)).alias("_end"))
    across = Window.partitionBy(key).orderBy("_block")
    ends = ends.withColumn("_carried", F.lag("_end").over(across)).drop("_end")
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    joined = blocked.join(ends, [key, "_block"]).withColumn("_previous", F.coalesce(F.lag(packed).over(inside), F.col("_carried")))
    return joined.withColumns({name: F.col(f"_previous.{source}") for source, name in columns.items()}).drop("_block", "_carried", "_previous")


def latest_states(accepted: DataFrame) -> DataFrame:
    """Current state per container after a batch: newest date wins, later arrival on ties."""
    order = F.struct("reading_date", "id")
    return accepted.groupBy("container_id").agg(
        F.max_by("level", order).alias("current_level"),
        F.max("reading_date").alias("last_reading"),
        F.max(F.when(F.col("collected"), F.col("reading_date"))).alias("last_pickup"),
        F.lit(True).alias("available"),
    )


def retention_cut(readings: DataFrame, containers: int | Column, periods: int) -> DataFrame:
    """One row: last id to drop and the first day kept, or nulls when less than one
    period is in excess."""
    per_period = containers if isinstance(containers, Column) else F.lit(containers)
    bounds = readings.agg(F.min("id").alias("oldest"), F.max("id").alias("newest"))
    last_drop = F.col("newest") - periods * per_period
    due = last_drop - F.col("oldest") + 1 >= per_period
    return bounds.select(F.when(due, last_drop).alias("last_id_to_drop"))


def days_to_drop(readings: DataFrame, cut: DataFrame) -> DataFrame:
    """Whole UTC days before the day of the first kept reading, with their row counts."""
    r = readings.withColumn("one", F.lit(1)).join(F.broadcast(cut.withColumn("one", F.lit(1))), "one")
    first_kept = (
        r.where(F.col("id") > F.col("last_id_to_drop"))
        .agg(F.min_by("reading_date", "id").alias("first_kept"))
        .select(F.to_date("first_kept").alias("first_day"), F.lit(1).alias("one"))
    )
    per_day = readings.groupBy(F.to_date("reading_date").alias("reading_day")).agg(F.count("*").alias("readings"))
    return (
        per_day.withColumn("one", F.lit(1))
        .join(F.broadcast(first_kept), "one")
        .where(F.col("reading_day") < F.col("first_day"))
        .select("reading_day", "readings")
    )


def retained(readings: DataFrame, cut: DataFrame) -> DataFrame:
    """Readings kept when storage is not partitioned: everything after the cut id."""
    r = readings.withColumn("one", F.lit(1)).join(F.broadcast(cut.withColumn("one", F.lit(1))), "one")
    return r.where(F.col("last_id_to_drop").isNull() | (F.col("id") > F.col("last_id_to_drop"))).drop("one", "last_id_to_drop")


def seeded_order(key: Column, seed: int) -> Column:
    """Repeatable pseudo-random order of integer keys (fixed linear congruence). The key is
    reduced first, so that no product leaves 64 bits."""
    return (key % 2147483648 * 1103515245 + seed % 2147483648 * 12345 + 1013904223) % 2147483648


def sample_sites(samples: DataFrame, first_cutoff: Column, last_cutoff: Column, start: Column, end: Column, size: int, seed: int = 0) -> DataFrame:
    """Random sites with readings both up to the first cutoff and after the last."""
    in_window = samples.where(F.col("timestamp").between(start, end))
    usable = (
        in_window.groupBy("site_id")
        .agg(
            F.count_if(F.col("timestamp") <= first_cutoff).alias("before"),
            F.count_if(F.col("timestamp") > last_cutoff).alias("after"),
        )
        .where((F.col("before") > 0) & (F.col("after") > 0))
    )
    return usable.orderBy(seeded_order(F.col("site_id"), seed), "site_id").limit(size).select("site_id")


def least_full_first(containers: DataFrame) -> DataFrame:
    """Rank of each active container within its site, emptiest first."""
    order = Window.partitionBy("site_id").orderBy("current_level", "id")
    return (
        containers.where(F.col("deleted_at").isNull())
        .withColumn("donor_rank", F.row_number().over(order))
        .select(F.col("id").alias("container_id"), "site_id", "current_level", "donor_rank")
    )
