"""The reading history: Parquet partitioned by UTC day, and what is written around it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.functions import text
from binflow.functions.numbers import half_even
from binflow.session import small


def with_day(readings: DataFrame) -> DataFrame:
    return readings.withColumn("reading_day", F.to_date("reading_date"))


def write_readings(readings: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned write, rebalanced by day: small days share a task and get one file each, a
    day of any size is split into tasks of about the session's advisory partition size."""
    with_day(readings).hint("rebalance", "reading_day").write.mode(mode).partitionBy("reading_day").parquet(path)


def read_window(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """Readings in [start, end]; the day filter prunes partitions, the other is pushed to
    the remaining files."""
    rows = spark.read.parquet(path)
    low, high = (F.lit(t.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz") for t in (start, end))
    days = F.col("reading_day").between(F.lit(start.date()), F.lit(end.date()))
    return rows.where(days & F.col("reading_date").between(low, high))


def drop_days(readings: DataFrame, days: DataFrame) -> DataFrame:
    """History without whole days (retention); `days` is (reading_day)."""
    return readings.join(small(days.select("reading_day")), "reading_day", "left_anti")


def measurement_export(measurements: DataFrame, containers: DataFrame, sites: DataFrame, collections: DataFrame) -> DataFrame:
    """Export rows: measurement with its container, site and collection (same time and
    container), derived volume and 0/1 flags."""
    c = containers.select(F.col("id").alias("container_id"), F.col("name").alias("container_name"), "site_id", "volume_m3", "waste_type_name")
    s = sites.select(F.col("id").alias("site_id"), F.col("name").alias("site_name"), F.col("zone").alias("zone_name"))
    at = collections.select("timestamp", "container_id").distinct().withColumn("picked", F.col("timestamp"))
    stamp = "yyyy-MM-dd'T'HH:mm:ss.'000000Z'"
    rows = measurements.join(small(c), "container_id").join(small(s), "site_id", "left").join(at, ["timestamp", "container_id"], "left")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return rows.select(
        "id",
        F.date_format("timestamp", stamp).alias("reading_date"),
        F.col("ultrasonic_distance_cm").alias("reported_height"),
        F.col("temperature_c").alias("reported_temperature"),
        F.coalesce(F.date_format("picked", stamp), F.lit("")).alias("reported_collection_date"),
        flag(F.col("collected")).alias("garbage_collection_alarm"),
        flag(F.col("anomaly") == "incendio").alias("fire_alarm"),
        F.lit(0).alias("freeze_alarm"),
        flag(F.col("acceleration_g") >= 2.5).alias("crash_alarm"),
        F.col("signal_rssi_dbm").alias("rssi"),
        "container_name",
        F.col("fill_level_pct").alias("container_current_level"),
        half_even(F.col("volume_m3") * F.col("fill_level_pct") / 100, 4).alias("container_current_m3"),
        F.coalesce("site_name", F.lit("")).alias("site_name"),
        F.coalesce("zone_name", F.lit("")).alias("zone_name"),
        "waste_type_name",
    )


def api_payload(measurements: DataFrame) -> DataFrame:
    """Nested messages, one JSON object per row when written with `write.json`."""
    return measurements.select(
        F.col("device_id"),
        F.col("container_id").cast("string").alias("container_id"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.struct("fill_level_pct", "ultrasonic_distance_cm", "battery_pct", "signal_rssi_dbm", "temperature_c", "acceleration_g").alias("telemetry"),
        F.struct(F.col("collected").alias("is_collection_detected"), "anomaly").alias("flags"),
    )


def zone_profile_features(tracts: DataFrame, profiles: DataFrame) -> DataFrame:
    """One GeoJSON feature text per tract: polygon and zone profile."""
    rings = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    rows = tracts.join(profiles, "radio_code")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"),
        F.struct(
            "radio_code", "department_name", "population", "zone_type",
            half_even(F.col("demand_multiplier"), 3).alias("demand_multiplier"), half_even(F.col("weekend_factor"), 3).alias("weekend_factor"),
        ).alias("properties"),
    )
    return rows.select("radio_code", F.to_json(feature).alias("feature"))


def missing_rows(existing: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Seed rows whose key is not stored yet, one per key: loading twice adds nothing."""
    return seed.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def load_reference(existing: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(missing_rows(existing, seed, key))


def with_source_prefix(seed: DataFrame, raw: str, prefix: str) -> DataFrame:
    return seed.withColumn("serie_id", text.source_serie_id(F.col(raw), prefix))
