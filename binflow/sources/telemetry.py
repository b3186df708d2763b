"""Telemetry JSON: one message per line, or batches under `measurements`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.functions import times
from binflow.session import numbered_by

MESSAGE = (
    "device_id string, container_id string, timestamp string,"
    " telemetry struct<fill_level_pct: double, ultrasonic_distance_cm: double, battery_pct: double,"
    " signal_rssi_dbm: double, temperature_c: double, acceleration_g: double>,"
    " flags struct<is_collection_detected: boolean, anomaly: string>"
)
_STRUCT = (
    "struct<device_id: string, container_id: string, timestamp: string,"
    " telemetry: struct<fill_level_pct: double, ultrasonic_distance_cm: double, battery_pct: double,"
    " signal_rssi_dbm: double, temperature_c: double, acceleration_g: double>,"
    " flags: struct<is_collection_detected: boolean, anomaly: string>>"
)
SCHEMA = f"{MESSAGE}, measurements array<{_STRUCT}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


# Columns that order messages by arrival: file time, file, offset of the block in it.
ARRIVAL = ("arrived", "file", "block")


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Messages with their arrival columns, oldest files first."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
    return raw.select(
        "*",
        F.col("_metadata.file_modification_time").alias("arrived"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


#: Rows that one batch may number; ids of a batch never reach those of the next.
BATCH_IDS = 2**40


def numbered(messages: DataFrame, batch_id: int = 0) -> DataFrame:
    """Batch rows with `id` rising in arrival order over all batches: by the arrival columns
    present, then by place in the file and in the message. Number before a join moves rows.

    An id is `batch_id * BATCH_IDS` plus the row's dense number in its batch.
    """
    if not 0 <= batch_id < 2**63 // BATCH_IDS:
        raise ValueError(f"batch {batch_id} is beyond the ids that fit 64 bits")
    order = [c for c in (*ARRIVAL, "_row", "position") if c in messages.columns or c == "_row"]
    rows = messages.withColumn("_row", F.monotonically_increasing_id())
    placed = numbered_by(rows, order, "_number").drop("_row")
    beyond = F.raise_error(F.lit("a batch holds more rows than BATCH_IDS"))
    number = F.when(F.col("_number") < BATCH_IDS, F.col("_number")).otherwise(beyond.cast("bigint"))
    return placed.withColumn("id", F.lit(batch_id * BATCH_IDS).cast("bigint") + number).drop("_number")


def normalise(raw: DataFrame, now: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Flat measurements with defaults: unreadable time -> now, battery 100,
    acceleration 1, fill 0. `keep` names columns of `raw` to pass through."""
    now = F.current_timestamp().cast(times.NTZ) if now is None else now
    single = F.struct("device_id", "container_id", "timestamp", "telemetry", "flags")
    messages = F.when(F.col("measurements").isNull(), F.array(single)).otherwise(F.col("measurements"))
    m = raw.select(*keep, F.posexplode(messages).alias("position", "m"))
    t = "m.telemetry."
    return m.select(
        *keep,
        "position",
        F.col("m.device_id").alias("device_id"),
        F.col("m.container_id").alias("raw_container_id"),
        F.coalesce(times.parse_time(F.col("m.timestamp")), now).alias("reading_date"),
        F.coalesce(t + "fill_level_pct", F.lit(0.0)).alias("fill_level_pct"),
        F.col(t + "ultrasonic_distance_cm").alias("ultrasonic_distance_cm"),
        F.coalesce(t + "battery_pct", F.lit(100.0)).alias("battery_pct"),
        F.col(t + "signal_rssi_dbm").alias("signal_rssi_dbm"),
        F.col(t + "temperature_c").alias("temperature_c"),
        F.coalesce(t + "acceleration_g", F.lit(1.0)).alias("acceleration_g"),
        F.coalesce("m.flags.is_collection_detected", F.lit(False)).alias("collected"),
        F.col("m.flags.anomaly").alias("anomaly"),
    )
