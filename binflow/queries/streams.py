"""Streams run over files that the given tables are dealt to, against their batch twins in SQL.

Each run works off everything available and ends; its input, output and checkpoint lie in new
folders under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow import adapter as a
from binflow.operators import filters
from binflow.queries.duck import half_even, with_ctes
from binflow.queries.network import _ALARM, measurements
from binflow.queries.registry import query
from binflow.queries.series import stored_buckets
from binflow.session import shared_folder
from binflow.streaming import series, state

#: Files that a table is dealt to, a batch each.
FILES = 4
#: Hours that a row may come after its time in these runs.
LATE = 48


def dealt(rows: DataFrame, part) -> DataFrame:
    """`rows` as a stream of FILES batches, in the order of `part`, from 0. All tasks look for a
    part's rows; one writes them, as a file."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    placed = rows.withColumn("_part", part.cast("int"))
    for k in range(FILES):
        placed.where(F.col("_part") == k).drop("_part").repartition(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def by_arrival(rows: DataFrame, time: str, key: str) -> DataFrame:
    """`rows` as a stream in order of arrival, up to LATE hours after their time, in a scrambled order."""
    arrival = F.unix_micros(F.col(time).cast("timestamp")) / 3_600_000_000 + F.pmod(F.xxhash64(key, time), F.lit(LATE))
    bounds = rows.agg(F.min(arrival).alias("lo"), F.max(arrival).alias("hi")).first()
    span = max(1e-9, (bounds.hi or 0) - (bounds.lo or 0))
    return dealt(rows, F.least(F.lit(FILES - 1), F.floor((arrival - (bounds.lo or 0)) / span * FILES)))


def finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = shared_folder(spark)
    state.run_available(stream, out, shared_folder(spark))
    return spark.read.schema(stream.schema).parquet(out)


def _readings(spark, sf):
    """Readings in the order of arrival, which is not that of their times."""
    r = a.readings(spark, sf).withColumn("seq", F.expr("id div 64 * 64 + (id * 37 + 11) % 64"))
    half = (r.agg(F.max("seq")).first()[0] or 0) + 1
    return dealt(r.select("container_id", "seq", "reading_date", "level", "collected"), F.floor(F.col("seq") * FILES / half))


_FLAGGED = (
    "(SELECT *, b IS NULL OR reading_date > b.d AS accepted, b.l AS level_old FROM (SELECT *, max({'d': reading_date, 's': -seq, 'l': level}) OVER (PARTITION BY container_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b"
    " FROM (SELECT *, id // 64 * 64 + (id * 37 + 11) % 64 AS seq FROM readings)))"
)


def _followed(spark, sf):
    state.use_disk_state(spark)
    return finished(spark, state.followed_readings(_readings(spark, sf)))


@query("s02_late_reading_stream", with_ctes("readings", f"SELECT container_id, seq, accepted, level_old FROM {_FLAGGED}"))
def _s02(spark, sf):
    return _followed(spark, sf).select("container_id", "seq", "accepted", "level_old")


@query(
    "s03_latest_state_stream",
    with_ctes(
        "readings",
        f"SELECT container_id, arg_max(level, seq) AS current_level, max(reading_date) AS last_reading, max(CASE WHEN collected THEN reading_date END) AS last_pickup FROM {_FLAGGED} WHERE accepted GROUP BY container_id",
    ),
)
def _s03(spark, sf):
    return state.latest_of(_followed(spark, sf))


@query(
    "s04_bucket_stream",
    with_ctes(
        "measured",
        f"SELECT site_id, mb AS timestamp, {half_even('avg(level)', 2)} AS level, CAST(sum(n) AS BIGINT) AS measurement_count, count(*) AS container_count, bool_or(collected) AS collected FROM measured"
        f" WHERE mb + INTERVAL 360 MINUTE <= (SELECT max(reading_date) FROM readings) - INTERVAL {LATE} HOUR GROUP BY site_id, mb",
    ),
)
def _s04(spark, sf):
    """What the watermark has passed by the end of the readings."""
    return finished(spark, series.bucket_stream(by_arrival(a.samples(spark, sf), "timestamp", "id"), 360, f"{LATE} hours"))


@query("s05_alarm_stream", with_ctes("measurements", f"SELECT id, {_ALARM} AS alarm_type FROM measurements WHERE {_ALARM} IS NOT NULL"))
def _s05(spark, sf):
    m = measurements(spark, sf)
    stream = dealt(m, F.pmod(F.xxhash64("id"), F.lit(FILES)))
    return finished(spark, filters.alarms(stream, keep=("id",))).select("id", "alarm_type")


@query(
    "s06_collection_event_stream",
    with_ctes(
        "events_on",
        "SELECT site_id, timestamp, previous_level, drop_points, CASE WHEN collected THEN 'garbage_collection_alarm' ELSE 'level_drop' END AS reason, coalesce(drop_points < 25, false) AS is_partial FROM events_on"
        f" WHERE is_event AND timestamp <= (SELECT max(timestamp) FROM buckets) - INTERVAL {LATE} HOUR",
    ),
)
def _s06(spark, sf):
    """Buckets in a scrambled order; events that the watermark has passed by their end."""
    state.use_disk_state(spark)
    rows = stored_buckets(spark, sf).select("site_id", "timestamp", "level", "collected")
    out = finished(spark, state.collection_event_stream(by_arrival(rows, "timestamp", "site_id"), f"{LATE} hours"))
    return out.select("site_id", "timestamp", "previous_level", "drop_points", "reason", "is_partial")
