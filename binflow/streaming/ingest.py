"""Telemetry ingest as a Structured Streaming query.

Every micro-batch resolves its containers, appends all readings to the day-partitioned
history (late ones too), and moves the container states with the readings that are newer
than the state. States are snapshots, one folder per batch number: a batch run again after a
failure reads the snapshot before it and overwrites its own, so nothing counts twice. Numbers
go on from one checkpoint to the next: a run from a new checkpoint continues the states and
the history of the runs before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from binflow.functions import times
from binflow.operators import filters, network, readings as arrivals
from binflow.session import attach, cut, numbered_by, small
from binflow.sources import telemetry
from binflow.sources.facts import with_day

STATE_COLUMNS = ("container_id", "site_id", "current_level", "last_reading", "last_pickup", "available", "change_version")


@dataclass(frozen=True)
class Snapshots:
    """A table kept as one full snapshot per batch id under a shared folder."""

    path: str

    def before(self, spark: SparkSession, batch_id: int, initial: DataFrame) -> DataFrame:
        return initial if batch_id == 0 else spark.read.parquet(f"{self.path}/batch={batch_id - 1}")

    def write(self, frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def at(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/batch={batch_id}")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


@dataclass(frozen=True)
class Runs:
    """The runs that wrote under a folder and the number at which each began, one row for a run.

    A run is a checkpoint: the id that a query keeps there tells runs apart, so a restart from
    the same checkpoint is the same run.
    """

    path: str

    def first_number(self, spark: SparkSession, checkpoint: str, snapshots: Snapshots) -> int:
        """The number of the run's batch 0: after all that is there when the run begins."""
        run = spark.read.json(f"{checkpoint}/metadata").select("id").first().id
        if exists(spark, f"{self.path}/run={run}"):
            return spark.read.parquet(f"{self.path}/run={run}").first().first
        highest = spark.read.parquet(snapshots.path).agg(F.max("batch")).first()[0] if exists(spark, snapshots.path) else None
        first = 0 if highest is None else int(highest) + 1
        spark.range(1).select(F.lit(first).alias("first")).write.mode("overwrite").parquet(f"{self.path}/run={run}")
        return first


def compacted(spark: SparkSession, history_path: str, out_path: str, files_per_day: int = 1) -> None:
    """A copy of the history with few files for each day, sorted by container and time.

    The history itself stays as it is, so a failure loses nothing; readers move to the copy
    once it is complete.
    """
    rows = spark.read.parquet(history_path)
    part = F.pmod(F.xxhash64("container_id"), F.lit(files_per_day))
    dealt = rows.repartition("reading_day", part).sortWithinPartitions("reading_day", "container_id", "reading_date")
    dealt.write.mode("errorifexists").partitionBy("reading_day").parquet(out_path)


def initial_states(containers: DataFrame) -> DataFrame:
    return containers.where(F.col("deleted_at").isNull()).select(
        F.col("id").alias("container_id"), "site_id", "current_level", "last_reading", "last_pickup", "available",
        F.coalesce("change_version", F.lit(0)).cast("bigint").alias("change_version"),
    )


def reset_states(states: DataFrame) -> DataFrame:
    """Empty containers and forget their readings; sites stay."""
    none = F.lit(None).cast(times.NTZ)
    return states.withColumn("current_level", F.lit(0)).withColumn("last_reading", none).withColumn("last_pickup", none)


def merge_states(states: DataFrame, batch: DataFrame) -> DataFrame:
    """States after a batch of accepted readings; the newest date wins, later arrival on
    ties. Every changed container gets a change version of its own, above all before it, in
    the order of ids."""
    new = arrivals.latest_states(batch).select(
        "container_id", F.col("current_level").alias("new_level"), F.col("last_reading").alias("new_reading"), F.col("last_pickup").alias("new_pickup")
    )
    new = numbered_by(new.join(states.select("container_id"), "container_id", "left_semi"), ["container_id"], "nth")
    highest = states.agg(F.coalesce(F.max("change_version"), F.lit(0)).alias("highest"))
    changed = F.col("new_reading").isNotNull()
    top = (F.col("highest") + F.col("nth") + 1).cast("bigint")
    return attach(states.join(new, "container_id", "left"), highest).select(
        "container_id", "site_id",
        F.coalesce("new_level", "current_level").alias("current_level"),
        F.coalesce("new_reading", "last_reading").alias("last_reading"),
        F.coalesce("new_pickup", "last_pickup").alias("last_pickup"),
        (F.col("available") | changed).alias("available"),
        F.when(changed, top).otherwise(F.col("change_version")).alias("change_version"),
    )


def resolve_batch(messages: DataFrame, containers: DataFrame, types: DataFrame) -> DataFrame:
    """Numbered messages with their container (null for unknown senders) and its volume."""
    resolved = network.resolve_identity(messages, containers)
    facts = containers.select(F.col("id").alias("container_id"), "container_type_id")
    volumes = types.select(F.col("id").alias("container_type_id"), "volume_m3")
    return resolved.join(small(facts.join(small(volumes), "container_type_id", "left").drop("container_type_id")), "container_id", "left")


def batch_counts(resolved: DataFrame) -> DataFrame:
    return resolved.agg(
        F.count("*").alias("received"), F.count("container_id").alias("updated"), F.count_if(F.col("container_id").isNull()).alias("not_found")
    )


def process_batch(resolved: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings to store, states after): all resolved readings with `accepted` and the
    level accepted before each."""
    rows = filters.telemetry_to_readings(resolved.where(F.col("container_id").isNotNull())).withColumn("level", F.col("container_current_level"))
    flagged = cut(arrivals.accepted_readings(rows, states=states.select("container_id", "current_level", "last_reading")))
    return flagged, merge_states(states, flagged.where("accepted"))


def start(
    raw: DataFrame, containers: DataFrame, types: DataFrame, history_path: str, states_path: str, checkpoint: str, after_batch=None, available_now: bool = False,
) -> StreamingQuery:
    """Start the ingest. Under `states_path` go the container states and the counts of
    received, updated and unknown messages, per batch. `after_batch(readings, batch, states_before, states_after)`
    runs once the history and the states are stored, so its failure loses no reading. Batch
    numbers go on where earlier runs ended."""
    snapshots, counts, runs = Snapshots(f"{states_path}/states"), Snapshots(f"{states_path}/counts"), Runs(f"{states_path}/runs")
    first, begun = initial_states(containers), []

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not begun:
            begun.append(runs.first_number(spark, checkpoint, snapshots))
        batch_id += begun[0]
        before = snapshots.before(spark, batch_id, first)
        messages = cut(telemetry.numbered(batch, batch_id))
        resolved = cut(resolve_batch(messages, containers, types))
        rows, after = process_batch(resolved, before)
        stored = with_day(rows.withColumn("batch", F.lit(batch_id)))
        # Own partitions per batch: a retried batch replaces exactly what it wrote.
        stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("reading_day", "batch").parquet(history_path)
        snapshots.write(after, batch_id)
        counts.write(batch_counts(resolved), batch_id)
        if after_batch is not None:
            after_batch(rows, batch_id, before, snapshots.at(spark, batch_id))

    flat = telemetry.normalise(raw, keep=[c for c in telemetry.ARRIVAL if c in raw.columns])
    writer = flat.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
