"""Checks of the site series: buckets, events, cycles, generation, arrival order."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow import adapter as a
from binflow.functions.numbers import half_even as even
from binflow.functions.numbers import half_up as up
from binflow.operators import history, network, readings as arrivals
from binflow.queries.duck import add_cte, half_even, half_up, with_ctes
from binflow.queries.registry import query
from binflow.session import cut

INTERVAL, CARRY = 360, 1080

add_cte(
    "measured",
    "readings",
    "SELECT site_id, container_id, time_bucket(INTERVAL 360 MINUTE, reading_date) AS mb, arg_max(level, (reading_date, id)) AS level, count(*) AS n, bool_or(collected) AS collected FROM readings GROUP BY ALL",
)
add_cte(
    "buckets",
    "measured",
    "SELECT b.site_id, b.bucket AS timestamp, "
    + half_even("avg(m.level)", 2)
    + " AS level, CAST(max(m.level) AS DOUBLE) AS max_level, CAST(min(m.level) AS DOUBLE) AS min_level, any_value(b.n) AS measurement_count,"
    " count(*) AS container_count, any_value(b.collected) AS collected FROM"
    " (SELECT site_id, mb AS bucket, CAST(sum(n) AS BIGINT) AS n, bool_or(collected) AS collected FROM measured GROUP BY ALL) b JOIN"
    " (SELECT *, coalesce(lead(mb) OVER (PARTITION BY container_id ORDER BY mb), TIMESTAMP '2100-01-01') AS nb FROM measured) m"
    " ON m.site_id = b.site_id AND m.mb <= b.bucket AND b.bucket < m.nb AND b.bucket - m.mb <= INTERVAL 1080 MINUTE GROUP BY b.site_id, b.bucket",
)
add_cte(
    "events_on",
    "buckets",
    "SELECT *, collected OR coalesce(drop_points, 0) >= 10 AS is_event FROM (SELECT *, CASE WHEN previous_level IS NOT NULL THEN "
    + half_even("greatest(0, previous_level - level)", 2)
    + " END AS drop_points FROM (SELECT *, lag(level) OVER (PARTITION BY site_id ORDER BY timestamp) AS previous_level FROM buckets))",
)
add_cte(
    "rise_rows",
    "events_on",
    "SELECT *, " + half_even("level - previous_level", 4) + " AS rise, is_event OR coalesce(level < previous_level, false) AS emptied FROM events_on",
)
add_cte(
    "typical",
    "rise_rows",
    "SELECT h.site_id, h.hour, h.m, o.overall FROM (SELECT site_id, hour(timestamp) AS hour, median(rise) AS m FROM rise_rows WHERE rise IS NOT NULL AND NOT emptied GROUP BY ALL) h"
    " JOIN (SELECT site_id, median(rise) AS overall FROM rise_rows WHERE rise IS NOT NULL AND NOT emptied GROUP BY ALL) o USING (site_id)",
)
add_cte(
    "generated",
    "typical rise_rows",
    "SELECT r.site_id, r.timestamp, r.level, CASE WHEN r.previous_level IS NULL THEN 0e0 WHEN r.emptied THEN coalesce(t.m, o.overall, 0e0) ELSE r.rise END AS generation FROM rise_rows r"
    " LEFT JOIN typical t ON t.site_id = r.site_id AND t.hour = hour(r.timestamp) LEFT JOIN (SELECT site_id, any_value(overall) AS overall FROM typical GROUP BY site_id) o ON o.site_id = r.site_id",
)


def buckets(spark, sf):
    return history.site_buckets(a.samples(spark, sf), INTERVAL, "avg", CARRY)


def stored_buckets(spark, sf):
    """Buckets written once, for queries that read them several times."""
    return cut(buckets(spark, sf))


@query("d10_site_buckets", with_ctes("buckets", "SELECT * FROM buckets"))
def _d10(spark, sf):
    return buckets(spark, sf).drop("avg_level")


@query(
    "d11_hourly_series",
    with_ctes(
        "readings active",
        "SELECT site_id, string_agg(CAST(lv AS VARCHAR), ',' ORDER BY hour) AS levels, CAST(count(*) FILTER (c) AS BIGINT) AS collected FROM (SELECT a.site_id, date_trunc('hour', r.reading_date) AS hour, CAST(round(avg(r.level) * 100) AS BIGINT) AS lv,"
        " bool_or(r.collected) AS c FROM readings r JOIN active a ON a.id = r.container_id WHERE r.reading_date BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' GROUP BY ALL) GROUP BY site_id",
    ),
)
def _d11(spark, sf):
    window = [F.expr(f"timestamp_ntz'2024-01-{d} 00:00:00'") for d in ("03", "28")]
    s = history.site_samples(a.readings(spark, sf), a.containers(spark, sf), *window)
    arrays = history.as_arrays(history.hourly_levels(s))
    return arrays.select(
        "site_id",
        F.array_join(F.transform("levels", lambda v: F.round(v * 100).cast("bigint").cast("string")), ",").alias("levels"),
        F.size(F.filter("collected", lambda c: c)).cast("bigint").alias("collected"),
    )


AS_OF = "TIMESTAMP '2024-01-02 12:00:00'"


def snapshots(spark, sf):
    latest = network.latest_levels(a.readings(spark, sf), F.expr("timestamp_ntz'2024-01-02 12:00:00'"))
    return history.site_snapshots(a.sites(spark, sf), a.containers(spark, sf), a.container_types(spark), latest)


add_cte(
    "snapshots",
    "live_sites active readings container_types",
    f"SELECT s.id AS site_id, coalesce(count(c.id) > 0 AND bool_and(l.level IS NOT NULL), false) AS complete, CASE WHEN count(c.id) > 0 AND bool_and(l.level IS NOT NULL) THEN {half_even('avg(l.level)', 2)} END AS level,"
    f" CASE WHEN count(c.id) > 0 AND bool_and(l.level IS NOT NULL) THEN {half_even('sum(greatest(0e0, least(100e0, CAST(l.level AS DOUBLE))) * t.volume_m3 / 100)', 3)} END AS current_volume_m3,"
    f" CASE WHEN count(c.id) > 0 AND bool_and(l.level IS NOT NULL) THEN {half_even('sum(t.volume_m3)', 3)} END AS capacity_m3"
    f" FROM live_sites s LEFT JOIN active c ON c.site_id = s.id LEFT JOIN (SELECT container_id, arg_max(level, (reading_date, id)) AS level FROM readings WHERE reading_date <= {AS_OF} GROUP BY 1) l ON l.container_id = c.id"
    " LEFT JOIN container_types t ON t.id = c.container_type_id GROUP BY s.id",
)


@query("d12_site_snapshots", with_ctes("snapshots", "SELECT * FROM snapshots"))
def _d12(spark, sf):
    return snapshots(spark, sf)


@query(
    "d12_current_site_levels",
    with_ctes("live_sites active", f"SELECT s.id AS site_id, coalesce({half_up('avg(c.current_level)', 2)}, 0e0) AS current_level FROM live_sites s LEFT JOIN active c ON c.site_id = s.id GROUP BY s.id"),
)
def _d12c(spark, sf):
    return history.current_site_levels(a.sites(spark, sf), a.containers(spark, sf))


@query(
    "d13_typical_increments",
    with_ctes("typical", f"SELECT site_id, hour, {half_up('m', 4)} AS typical, {half_up('overall', 4)} AS overall FROM typical"),
)
def _d13(spark, sf):
    t = history.typical_increments(history.rises(stored_buckets(spark, sf)))
    return t.select("site_id", F.explode("by_hour").alias("hour", "m"), "overall").select(
        "site_id", "hour", up(F.col("m"), 4).alias("typical"), up(F.col("overall"), 4).alias("overall")
    )


@query(
    "d14_increment_profile",
    with_ctes(
        "rise_rows",
        f"SELECT site_id, isodow(timestamp) - 1 AS weekday, hour(timestamp) AS hour, {half_up('median(rise)', 4)} AS typical, count(*) AS cases FROM rise_rows WHERE NOT is_event AND rise > 0 GROUP BY ALL",
    ),
)
def _d14(spark, sf):
    p = history.increment_profile(buckets(spark, sf)).select("site_id", F.explode("weekly").alias("slot", "v"))
    return p.select(
        "site_id", F.expr("slot div 24").cast("int").alias("weekday"), (F.col("slot") % 24).alias("hour"), up(F.col("v.m"), 4).alias("typical"), F.col("v.n").alias("cases")
    )


@query("d15_time_bounds", "SELECT min(ts) AS earliest, max(ts) AS latest FROM events")
def _d15(spark, sf):
    return history.time_bounds(a.readings(spark, sf))


@query(
    "e01_collection_events",
    with_ctes(
        "events_on",
        "SELECT site_id, timestamp, previous_level, drop_points, CASE WHEN collected THEN 'garbage_collection_alarm' ELSE 'level_drop' END AS reason, coalesce(drop_points < 25, false) AS is_partial FROM events_on WHERE is_event",
    ),
)
def _e01(spark, sf):
    e = history.with_events(buckets(spark, sf)).where("is_event")
    return e.select("site_id", "timestamp", "previous_level", "drop_points", "reason", "is_partial")


@query(
    "e02_collection_cycles",
    with_ctes(
        "events_on",
        f"SELECT site_id, cycle, min(timestamp) AS started_at, max(CASE WHEN closes THEN timestamp END) AS ended_at, arg_min(level, timestamp) AS start_level, arg_max(level, timestamp) AS end_level, count(*) AS bucket_count,"
        f" {half_even('(epoch(max(CASE WHEN closes THEN timestamp END)) - epoch(min(timestamp))) / 3600e0', 2)} AS duration_hours FROM ("
        "SELECT site_id, timestamp, level, c AS cycle, false AS closes FROM (SELECT *, CAST(sum(CAST(is_event AS INTEGER)) OVER (PARTITION BY site_id ORDER BY timestamp) AS BIGINT) AS c FROM events_on)"
        " UNION ALL SELECT site_id, timestamp, level, c - 1, true FROM (SELECT *, CAST(sum(CAST(is_event AS INTEGER)) OVER (PARTITION BY site_id ORDER BY timestamp) AS BIGINT) AS c FROM events_on) WHERE is_event) GROUP BY site_id, cycle",
    ),
)
def _e02(spark, sf):
    c = history.collection_cycles(buckets(spark, sf))
    return c.select("site_id", "cycle", "started_at", "ended_at", "start_level", "end_level", "bucket_count", "duration_hours")


@query("e03_generation", with_ctes("generated", f"SELECT site_id, timestamp, {half_even('generation', 4)} AS generation FROM generated"))
def _e03(spark, sf):
    return history.generation(stored_buckets(spark, sf)).select("site_id", "timestamp", "generation")


SPLIT = "2024-01-20 00:00:00"
add_cte(
    "uncollected",
    "rise_rows",
    f"SELECT *, coalesce(lag(uncollected) OVER (PARTITION BY site_id ORDER BY timestamp), start_level) AS level_before FROM (SELECT r.site_id, r.timestamp, s.start_level, s.start_level + sum(CASE WHEN r.emptied THEN coalesce(t.m, o.m, 0e0) ELSE r.rise END)"
    f" OVER (PARTITION BY r.site_id ORDER BY r.timestamp) AS uncollected FROM rise_rows r JOIN (SELECT site_id, arg_max(level, timestamp) AS start_level FROM rise_rows WHERE timestamp <= TIMESTAMP '{SPLIT}' GROUP BY 1) s ON s.site_id = r.site_id"
    f" LEFT JOIN (SELECT site_id, hour(timestamp) AS h, median(rise) AS m FROM rise_rows WHERE rise IS NOT NULL AND NOT emptied AND timestamp <= TIMESTAMP '{SPLIT}' GROUP BY ALL) t ON t.site_id = r.site_id AND t.h = hour(r.timestamp)"
    f" LEFT JOIN (SELECT site_id, median(rise) AS m FROM rise_rows WHERE rise IS NOT NULL AND NOT emptied AND timestamp <= TIMESTAMP '{SPLIT}' GROUP BY ALL) o ON o.site_id = r.site_id"
    f" WHERE r.timestamp > TIMESTAMP '{SPLIT}')",
)


def _uncollected(spark, sf):
    b = stored_buckets(spark, sf).withColumn("observed", F.col("timestamp") > F.expr(f"timestamp_ntz'{SPLIT}'"))
    return history.uncollected_levels(b)


@query("e04_uncollected_levels", with_ctes("uncollected", f"SELECT site_id, timestamp, start_level, {half_even('uncollected', 4)} AS uncollected FROM uncollected"))
def _e04(spark, sf):
    return _uncollected(spark, sf).select("site_id", "timestamp", "start_level", even(F.col("uncollected"), 4).alias("uncollected"))


@query(
    "e05_first_crossing",
    with_ctes("uncollected", "SELECT site_id, min(CASE WHEN level_before >= 80 OR uncollected >= 80 THEN timestamp END) AS crossed_at FROM uncollected GROUP BY site_id"),
)
def _e05(spark, sf):
    return history.first_crossing(_uncollected(spark, sf), 80.0)


def _arrivals(spark, sf):
    """Events in a scrambled arrival order, so that many come late."""
    r = a.readings(spark, sf)
    return r.withColumn("seq", F.expr("id div 64 * 64 + (id * 37 + 11) % 64"))


_ARRIVALS = "(SELECT *, id // 64 * 64 + (id * 37 + 11) % 64 AS seq FROM readings)"


@query(
    "e07_accepted_readings",
    with_ctes(
        "readings",
        "SELECT id, container_id, b IS NULL OR reading_date > b.d AS accepted, b.l AS level_old FROM (SELECT *, max({'d': reading_date, 's': -seq, 'l': level}) OVER (PARTITION BY container_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b"
        f" FROM {_ARRIVALS})",
    ),
)
def _e07(spark, sf):
    rows = arrivals.accepted_readings(_arrivals(spark, sf), "seq", block_rows=2000)
    return rows.select("id", "container_id", "accepted", "level_old")


@query(
    "f04_least_full_first",
    with_ctes("active", "SELECT id AS container_id, site_id, current_level, row_number() OVER (PARTITION BY site_id ORDER BY current_level, id) AS donor_rank FROM active"),
)
def _f04(spark, sf):
    return arrivals.least_full_first(a.containers(spark, sf))


@query(
    "f05_sample_sites",
    with_ctes(
        "readings",
        "SELECT site_id FROM readings WHERE reading_date BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29' GROUP BY site_id HAVING count(*) FILTER (reading_date <= TIMESTAMP '2024-01-05') > 0 AND count(*) FILTER (reading_date > TIMESTAMP '2024-01-27') > 0"
        " ORDER BY (site_id * 1103515245 + 7 * 12345 + 1013904223) % 2147483648, site_id LIMIT 20",
    ),
)
def _f05(spark, sf):
    at = [F.expr(f"timestamp_ntz'2024-01-{d} 00:00:00'") for d in ("05", "27", "02", "29")]
    return arrivals.sample_sites(a.samples(spark, sf), *at, size=20, seed=7)


def _cut(spark, sf, r):
    return arrivals.retention_cut(r, F.lit(150), 20)


@query(
    "f06_days_to_drop",
    "SELECT CAST(ts AS DATE) AS reading_day, count(*) AS readings FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(arg_min(ts, event_id) AS DATE) FROM events WHERE event_id > (SELECT max(event_id) - 20 * 150 FROM events)) GROUP BY 1",
)
def _f06(spark, sf):
    r = a.readings(spark, sf)
    return arrivals.days_to_drop(r, _cut(spark, sf, r))


@query(
    "f06_retained",
    "SELECT event_id AS id FROM events WHERE event_id > (SELECT max(event_id) - 20 * 150 FROM events)",
)
def _f06r(spark, sf):
    r = a.readings(spark, sf)
    return arrivals.retained(r, _cut(spark, sf, r)).select("id")
