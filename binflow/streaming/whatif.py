"""The what-if network fed by the ingest: replay and network counters per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.plans import whatif
from binflow.session import cut
from binflow.streaming.ingest import Snapshots


def whatif_readings(rows: DataFrame) -> DataFrame:
    """Accepted readings in the shape of the replay."""
    return rows.where("accepted").select(
        "container_id", F.col("id").alias("seq"), F.col("level_old").alias("level_before"), F.col("level").alias("level_after"), "reading_date", "collected"
    )


class WhatIfFollower:
    """`after_batch` hook of the ingest: keeps the virtual state and the counters.

    State snapshots and counters are stored per batch id, so a repeated batch replaces
    its own output.
    """

    def __init__(self, plan_id: int, start_state: DataFrame, sites: DataFrame, state_path: str, counts_path: str) -> None:
        self.plan_id, self.start_state, self.sites = plan_id, start_state, sites
        self.states, self.counts_path = Snapshots(state_path), counts_path

    def __call__(self, rows: DataFrame, batch_id: int, before: DataFrame, after: DataFrame) -> None:
        spark = rows.sparkSession
        state = self.states.before(spark, batch_id, self.start_state)
        homes = after.select(F.col("container_id").alias("id"), "site_id")
        readings = cut(whatif_readings(rows))
        self.states.write(whatif.replay(state, readings, homes), batch_id)
        network = after.select(F.col("container_id").alias("id"), "site_id", "current_level", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
        counts = whatif.network_counts(self.sites, network, self.states.at(spark, batch_id))
        clock = readings.agg(F.max("reading_date").alias("observed_at")).where(F.col("observed_at").isNotNull())
        row = counts.withColumn("one", F.lit(1)).join(clock.withColumn("one", F.lit(1)), "one").drop("one")
        row.withColumn("plan_id", F.lit(self.plan_id).cast("bigint")).write.mode("overwrite").parquet(f"{self.counts_path}/batch={batch_id}")


def tracked(counts: DataFrame) -> DataFrame:
    """Hour-weighted totals of the stored counters, at most one count per five minutes."""
    return whatif.tracked_totals(whatif.thin_counts(counts.select("plan_id", "observed_at", *whatif.COUNTS)))
