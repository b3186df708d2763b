"""Site series as streams: buckets, alarms and collection events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from binflow.functions import times
from binflow.functions.numbers import half_even
from binflow.operators.history import PARTIAL_DROP, STRONG_DROP


def bucket_stream(samples: DataFrame, interval_minutes: int = 60, lateness: str = "1 day") -> DataFrame:
    """Bucket rows per site, each emitted once the watermark passes it. Containers reduce
    to their last level first, as in the batch series; carry happens when reading."""
    at = samples.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", lateness)
    w = F.window("event_time", f"{interval_minutes} minutes")
    last = at.groupBy(w, "site_id", "container_id").agg(
        F.max_by("level", F.struct("event_time", "id")).alias("level"), F.count("*").alias("n"), F.bool_or("collected").alias("collected")
    )
    rolled = last.groupBy("window", "site_id").agg(
        half_even(F.avg("level"), 2).alias("level"), F.sum("n").alias("measurement_count"), F.count("*").alias("container_count"), F.bool_or("collected").alias("collected")
    )
    return rolled.select(
        "site_id", F.col("window.start").cast(times.NTZ).alias("timestamp"), "level", "measurement_count", "container_count", "collected"
    )


EVENT_SCHEMA = "site_id bigint, timestamp timestamp, previous_level double, current_level double, drop_points double, reason string, is_partial boolean"


def collection_events(buckets: DataFrame) -> DataFrame:
    """Collection events of a stream of bucket rows; state is the last level per site.

    Buckets of a site must come in time order across batches, as `bucket_stream` emits
    them; inside a batch they are sorted here.
    """

    def detect(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("timestamp")
        found = []
        for ts, level, collected in zip(rows["timestamp"], rows["level"], rows["collected"]):
            drop = None if previous is None else round(max(0.0, previous - level), 2)
            if collected or (drop is not None and drop >= PARTIAL_DROP):
                reason = "garbage_collection_alarm" if collected else "level_drop"
                found.append((key[0], ts, previous, level, drop, reason, drop is not None and drop < STRONG_DROP))
            previous = level
        state.update((float(previous),))
        yield pd.DataFrame(found, columns=[c.split()[0] for c in EVENT_SCHEMA.split(", ")])

    typed = buckets.select("site_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "level", "collected")
    return typed.groupBy("site_id").applyInPandasWithState(detect, EVENT_SCHEMA, "level double", "append", GroupStateTimeout.NoTimeout)
