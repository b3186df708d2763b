"""Checks of sources, sinks, partitioned history and stream twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow import adapter as a
from binflow.functions.numbers import half_even as even
from binflow.operators import filters, history, readings as arrivals
from binflow.queries.demand import land_use, tracts
from binflow.queries.duck import add_cte, half_even, with_ctes
from binflow.queries.network import _ALARM, measurements
from binflow.queries.registry import query
from binflow.queries.territory import polygons
from binflow.sources import facts, telemetry


def _payload(spark, sf):
    m = measurements(spark, sf).withColumn("device_id", F.concat(F.lit("dev-"), "container_id"))
    return facts.api_payload(m)


@query(
    "a01_telemetry_messages",
    "SELECT user_id AS container_id, ts AS reading_date, least(value, 110e0) AS fill_level_pct, CASE WHEN event_id % 101 > 50 THEN CAST(event_id % 101 AS DOUBLE) ELSE 100e0 END AS battery_pct, event_type = 'purchase' AS collected FROM events",
)
def _a01(spark, sf):
    """Messages as JSON text, parsed back with the source's schema and defaults."""
    p = _payload(spark, sf)
    low = F.col("telemetry.battery_pct") > 50
    p = p.withColumn("telemetry", F.col("telemetry").withField("battery_pct", F.when(low, F.col("telemetry.battery_pct"))))
    body = p.select(F.to_json(F.struct("*")).alias("j"))
    raw = body.select(F.from_json("j", telemetry.SCHEMA).alias("m")).select("m.*")
    out = telemetry.normalise(raw)
    return out.select(F.col("raw_container_id").cast("bigint").alias("container_id"), "reading_date", "fill_level_pct", "battery_pct", "collected")


@query(
    "a08_measurement_export",
    with_ctes(
        "measurements container_types",
        "SELECT m.id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '.000000Z' AS reading_date, CASE WHEN collected THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '.000000Z' ELSE '' END AS reported_collection_date, CAST(collected AS INTEGER) AS garbage_collection_alarm,"
        " CAST(coalesce(anomaly = 'incendio', false) AS INTEGER) AS fire_alarm, CAST(acceleration_g >= 2.5e0 AS INTEGER) AS crash_alarm, 'C' || container_id AS container_name, " + half_even("t.volume_m3 * fill_level_pct / 100", 4) + " AS container_current_m3, 'Sitio ' || (container_id // 3) AS site_name"
        " FROM measurements m JOIN container_types t ON t.id = 1 + container_id // 3 % 4",
    ),
)
def _a08(spark, sf):
    m = measurements(spark, sf)
    types = a.container_types(spark).select(F.col("id").alias("container_type_id"), "volume_m3", F.col("name").alias("waste_type_name"))
    c = a.containers(spark, sf).join(F.broadcast(types), "container_type_id").select("id", F.concat(F.lit("C"), "id").alias("name"), "site_id", "volume_m3", "waste_type_name")
    s = c.select("site_id").distinct().select(F.col("site_id").alias("id"), F.concat(F.lit("Sitio "), "site_id").alias("name"), F.lit("z").alias("zone"))
    picked = m.where("collected").select("timestamp", "container_id")
    out = facts.measurement_export(m, c, s, picked)
    return out.select("id", "reading_date", "reported_collection_date", "garbage_collection_alarm", "fire_alarm", "crash_alarm", "container_name", "container_current_m3", "site_name")


@query(
    "a09_api_payload",
    with_ctes("measurements", "SELECT 'dev-' || container_id AS device_id, CAST(container_id AS VARCHAR) AS container_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, fill_level_pct, anomaly FROM measurements"),
)
def _a09(spark, sf):
    return _payload(spark, sf).select("device_id", "container_id", "timestamp", "telemetry.fill_level_pct", "flags.anomaly")


@query("a10_readings_per_day", "SELECT CAST(ts AS DATE) AS reading_day, count(*) AS readings FROM events GROUP BY 1")
def _a10(spark, sf):
    return facts.with_day(a.readings(spark, sf)).groupBy("reading_day").agg(F.count("*").alias("readings"))


@query(
    "a11_window_read",
    with_ctes("readings active", "SELECT r.id, a.site_id, r.level FROM readings r JOIN active a ON a.id = r.container_id WHERE r.reading_date BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-17 18:00:00'"),
)
def _a11(spark, sf):
    window = [F.expr(f"timestamp_ntz'2024-01-{t}:00:00'") for t in ("10 06", "17 18")]
    s = history.site_samples(facts.with_day(a.readings(spark, sf)), a.containers(spark, sf), *window)
    return s.select("id", "site_id", F.col("level").cast("int").alias("level"))


@query(
    "a12_zone_profile_layer",
    with_ctes(
        "land_use edges",
        "SELECT CAST(s_suppkey AS VARCHAR) AS radio_code, 'Feature' AS type, 'Polygon' AS shape, 5 AS corners, e.x, e.y, 'Comuna ' || (s_suppkey % 5) AS department_name, s_suppkey % 9 * 40 AS population, l.zone_type,"
        f" {half_even('l.demand_multiplier', 3)} AS demand_multiplier, {half_even('l.weekend_factor', 3)} AS weekend_factor FROM supplier JOIN land_use l ON CAST(l.zone AS VARCHAR) = CAST(s_suppkey AS VARCHAR)"
        f" JOIN (SELECT polygon_id, {half_even('ax', 6)} AS x, {half_even('ay', 6)} AS y FROM edges WHERE i = 0) e ON e.polygon_id = s_suppkey",
    ),
)
def _a12(spark, sf):
    """The layer's features, read back from their text."""
    shapes = polygons(spark, sf).withColumn("radio_code", F.col("polygon_id").cast("string"))
    t = tracts(spark, sf).join(shapes.select("radio_code", "rings"), "radio_code")
    p = land_use(spark, sf).select(F.col("zone").cast("string").alias("radio_code"), "zone_type", "demand_multiplier", "weekend_factor")
    properties = "radio_code: string, department_name: string, population: bigint, zone_type: string, demand_multiplier: double, weekend_factor: double"
    schema = f"type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<{properties}>"
    f = facts.zone_profile_features(t, p).select(F.from_json("feature", schema).alias("f")).select("f.*")
    ring = F.col("geometry.coordinates")[0]
    return f.select(
        "properties.radio_code", "type", F.col("geometry.type").alias("shape"), F.size(ring).alias("corners"), even(ring[0][0], 6).alias("x"), even(ring[0][1], 6).alias("y"),
        "properties.department_name", "properties.population", "properties.zone_type", "properties.demand_multiplier", "properties.weekend_factor",
    )


@query(
    "a13_reference_load",
    "SELECT name FROM (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_brand FROM part)",
)
def _a13(spark, sf):
    p = a.table(spark, sf, "part")
    stored = p.select(F.col("p_name").alias("name")).distinct()
    once = facts.load_reference(stored, p.select(F.col("p_brand").alias("name")), "name")
    return facts.load_reference(once, p.select(F.col("p_brand").alias("name")), "name")


@query("a13_source_prefix", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'negros|' || c_custkey ELSE 'verdes|' || c_custkey END AS serie_id FROM customer")
def _a13s(spark, sf):
    k = F.col("c_custkey")
    seed = a.table(spark, sf, "customer").select(k.alias("id"), F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("verdes|"), k)).alias("raw"))
    return facts.with_source_prefix(seed, "raw", "negros").select("id", "serie_id")


@query("a07_count_check", "SELECT event_type AS file, count(*) AS source_rows, count(*) FILTER (value >= 1) AS loaded_rows, count(*) FILTER (value < 1) AS missing, count(*) FILTER (value < 1) = 0 AS complete FROM events GROUP BY 1")
def _a07(spark, sf):
    from binflow.sources.tables import count_check

    e = a.table(spark, sf, "events").withColumnRenamed("event_type", "file")
    return count_check(e, e.where(F.col("value") >= 1))


@query("s05_alarm_stream_twin", with_ctes("measurements", f"SELECT {_ALARM} AS alarm_type, count(*) AS alarms FROM measurements WHERE {_ALARM} IS NOT NULL GROUP BY 1"))
def _s05(spark, sf):
    return filters.alarms(measurements(spark, sf), keep=("id",)).groupBy("alarm_type").agg(F.count("*").alias("alarms"))


@query(
    "s03_latest_states",
    with_ctes(
        "readings",
        "SELECT container_id, arg_max(level, (reading_date, id)) AS current_level, max(reading_date) AS last_reading, max(CASE WHEN collected THEN reading_date END) AS last_pickup FROM readings GROUP BY 1",
    ),
)
def _s03(spark, sf):
    return arrivals.latest_states(a.readings(spark, sf)).select("container_id", "current_level", "last_reading", "last_pickup")


@query(
    "s04_bucket_stream_twin",
    with_ctes(
        "measured",
        f"SELECT site_id, mb AS timestamp, {half_even('avg(level)', 2)} AS level, CAST(sum(n) AS BIGINT) AS measurement_count, count(*) AS container_count, bool_or(collected) AS collected FROM measured GROUP BY site_id, mb",
    ),
)
def _s04(spark, sf):
    b = history.site_buckets(a.samples(spark, sf), 360, carry=0)
    return b.select("site_id", "timestamp", "level", "measurement_count", "container_count", "collected")
