"""Checks of filters, dimension joins, site levels, KPIs and change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow import adapter as a
from binflow.functions import geo, levels, numbers, text, times
from binflow.operators import filters, network
from binflow.queries.duck import CTES, category, half_even, half_up, haversine, with_ctes
from binflow.queries.registry import query
from binflow.session import attach

BOX = (-34.69, -34.64, -58.53, -58.51)


@query(
    "b01_bounding_box_sites",
    with_ctes("live_sites", "SELECT id, latitude, longitude FROM live_sites WHERE latitude BETWEEN -34.69e0 AND -34.64e0 AND longitude BETWEEN -58.53e0 AND -58.51e0"),
)
def _b01(spark, sf):
    return filters.in_box(filters.active(a.sites(spark, sf)), *BOX).select("id", "latitude", "longitude")


@query(
    "b01_bounding_box_containers",
    with_ctes("active", "SELECT id, latitude, longitude FROM active WHERE latitude > -34.69e0 AND latitude < -34.64e0 AND longitude > -58.53e0 AND longitude < -58.51e0"),
)
def _b01c(spark, sf):
    return filters.in_box(filters.active(a.containers(spark, sf)), *BOX, closed=False).select("id", "latitude", "longitude")


@query(
    "b02_soft_delete_outer_join",
    with_ctes("live_sites active", "SELECT s.id AS site_id, count(c.id) AS container_count FROM live_sites s LEFT JOIN active c ON c.site_id = s.id GROUP BY s.id"),
)
def _b02(spark, sf):
    return network.site_levels(a.sites(spark, sf), filters.active(a.containers(spark, sf))).select("site_id", "container_count")


_WASTE_JOIN = "live_sites s LEFT JOIN waste_types w ON w.id = s.waste_type_id"


@query(
    "b03_wet_sites",
    with_ctes("live_sites waste_types", f"SELECT s.id FROM {_WASTE_JOIN} WHERE lower(coalesce(w.name, 'húmeda')) LIKE '%húmed%'"),
)
def _b03(spark, sf):
    w = a.waste_types(spark).select(F.col("id").alias("waste_type_id"), F.col("name").alias("waste_type_name"))
    s = filters.active(a.sites(spark, sf)).join(F.broadcast(w), "waste_type_id", "left")
    return filters.waste_kind(s, "humedo").select("id")


@query(
    "b03_dry_sites",
    with_ctes("live_sites waste_types", f"SELECT s.id FROM {_WASTE_JOIN} WHERE lower(coalesce(w.name, '')) LIKE '%seca%'"),
)
def _b03d(spark, sf):
    w = a.waste_types(spark).select(F.col("id").alias("waste_type_id"), F.col("name").alias("waste_type_name"))
    s = filters.active(a.sites(spark, sf)).join(F.broadcast(w), "waste_type_id", "left")
    return filters.waste_kind(s, "reciclable").select("id")


def _enriched(spark, sf):
    return network.with_dimensions(
        a.containers(spark, sf), a.container_types(spark), a.type_waste_links(spark), a.waste_types(spark),
        a.neighborhoods(spark, sf), a.sites(spark, sf),
    )


_SEARCH_FROM = (
    "FROM active c LEFT JOIN sites s ON s.id = c.site_id LEFT JOIN neighborhoods n ON n.id = c.neighborhood_id"
    " LEFT JOIN container_types t ON t.id = c.container_type_id"
)


@query(
    "b04_free_text_search",
    with_ctes(
        "active sites neighborhoods container_types",
        f"SELECT c.id, c.site_id, c.current_level {_SEARCH_FROM} WHERE (CAST(c.site_id AS VARCHAR) ILIKE '%nation_1%' OR s.name ILIKE '%nation_1%'"
        " OR n.name ILIKE '%nation_1%' OR CAST(c.id AS VARCHAR) ILIKE '%nation_1%') AND t.name ILIKE '%húmeda%' AND c.current_level >= 20",
    ),
)
def _b04(spark, sf):
    rows = _enriched(spark, sf).withColumn("container_type", F.col("container_type.name"))
    t = levels.Thresholds(normal=5, high=10, critical=20)
    return filters.search(rows, "nation_1", "húmeda", True, t).select("id", "site_id", "current_level")


@query("b05_level_category", with_ctes("readings", f"SELECT id, {category('level')} AS category FROM readings"))
def _b05(spark, sf):
    return a.readings(spark, sf).select("id", levels.level_category(F.col("level")).alias("category"))


@query(
    "b06_utilisation_category",
    "SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_quantity / 50 >= 0.85e0 THEN 'critical' WHEN l_quantity / 50 >= 0.65e0 THEN 'high'"
    " WHEN l_quantity / 50 >= 0.35e0 THEN 'normal' WHEN l_quantity / 50 >= 0.15e0 THEN 'low' ELSE 'idle' END AS category FROM lineitem",
)
def _b06(spark, sf):
    li = a.table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), levels.score_category(F.col("l_quantity") / 50).alias("category"))


def measurements(spark, sf):
    """Synthetic telemetry columns over every event, for the alarm and quality rules."""
    e = a.table(spark, sf, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").alias("container_id"),
        F.least(F.col("value"), F.lit(110.0)).alias("fill_level_pct"),
        (k % 80).cast("double").alias("temperature_c"),
        (k % 101).cast("double").alias("battery_pct"),
        (-(k % 121)).cast("double").alias("signal_rssi_dbm"),
        (k % 301 - 5).cast("double").alias("ultrasonic_distance_cm"),
        (k % 31 / F.lit(10.0)).alias("acceleration_g"),
        F.when(k % 11 == 0, "sensor_trabado").when(k % 13 == 0, "sensor_ruidoso").when(k % 17 == 0, "incendio").alias("anomaly"),
        (F.col("event_type") == "purchase").alias("collected"),
    )


CTES["measurements"] = (
    (),
    "SELECT event_id AS id, ts AS timestamp, user_id AS container_id, least(value, 110e0) AS fill_level_pct,"
    " CAST(event_id % 80 AS DOUBLE) AS temperature_c, CAST(event_id % 101 AS DOUBLE) AS battery_pct,"
    " CAST(-(event_id % 121) AS DOUBLE) AS signal_rssi_dbm, CAST(event_id % 301 - 5 AS DOUBLE) AS ultrasonic_distance_cm,"
    " event_id % 31 / 10e0 AS acceleration_g, CASE WHEN event_id % 11 = 0 THEN 'sensor_trabado' WHEN event_id % 13 = 0 THEN 'sensor_ruidoso'"
    " WHEN event_id % 17 = 0 THEN 'incendio' END AS anomaly, event_type = 'purchase' AS collected FROM events",
)
_ALARM = (
    "CASE WHEN fill_level_pct >= 95 THEN 'desborde' WHEN temperature_c >= 70 THEN 'incendio' WHEN battery_pct <= 15 THEN 'bateria_baja'"
    " WHEN signal_rssi_dbm <= -115 THEN 'perdida_senal' WHEN anomaly IN ('sensor_trabado', 'sensor_ruidoso') THEN anomaly END"
)


@query(
    "b07_alarms",
    with_ctes(
        "measurements",
        f"SELECT * FROM (SELECT id, container_id, {_ALARM} AS alarm_type FROM measurements) q, LATERAL (SELECT CASE WHEN alarm_type IN ('desborde', 'incendio')"
        " THEN 'critical' ELSE 'warning' END AS severity) WHERE alarm_type IS NOT NULL",
    ),
)
def _b07(spark, sf):
    return filters.alarms(measurements(spark, sf), keep=("id", "container_id"))


@query(
    "b08_telemetry_projection",
    with_ctes(
        "measurements container_types",
        f"SELECT m.id, CAST(round_even(fill_level_pct, 0) AS INTEGER) AS container_current_level,"
        f" {half_even('t.volume_m3 * CAST(round_even(fill_level_pct, 0) AS INTEGER) / 100', 4)} AS container_current_m3,"
        " coalesce(anomaly = 'incendio', false) AS fire_alarm, acceleration_g >= 2.5e0 AS crash_alarm, battery_pct <= 15 AS reported_low_consumption_voltage,"
        " collected AS garbage_collection_alarm, CASE WHEN collected THEN timestamp END AS reported_collection_date"
        " FROM measurements m JOIN container_types t ON t.id = 1 + m.container_id // 3 % 4",
    ),
)
def _b08(spark, sf):
    t = a.container_types(spark).select(F.col("id").alias("type_id"), "volume_m3")
    m = measurements(spark, sf).withColumn("type_id", F.expr("1 + container_id div 3 % 4")).withColumn("reading_date", F.col("timestamp"))
    return filters.telemetry_to_readings(m.join(F.broadcast(t), "type_id")).select(
        "id", "container_current_level", "container_current_m3", "fire_alarm", "crash_alarm",
        "reported_low_consumption_voltage", "garbage_collection_alarm", "reported_collection_date",
    )


@query(
    "b09_container_type_of_file",
    "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'Lateral Fracción Seca' WHEN p_type LIKE 'ECO%' THEN 'Bilateral Fracción Húmeda'"
    " WHEN p_type LIKE 'PROMO%' THEN 'Soterrado Fracción Húmeda' ELSE 'Lateral Fracción Húmeda' END AS container_type FROM part",
)
def _b09(spark, sf):
    p = a.table(spark, sf, "part")
    file_name = F.when(F.col("p_size") % 3 == 0, "contenedores_verdes.json").otherwise("contenedores_negros.json")
    code = F.when(F.col("p_type").like("ECO%"), "BILATERAL").when(F.col("p_type").like("PROMO%"), "SOTERRADO").otherwise("X")
    return p.select(F.col("p_partkey").alias("id"), filters.container_type_name(file_name, code).alias("container_type"))


_WASTE_NAMES = (
    "CASE p_partkey % 6 WHEN 0 THEN 'organico' WHEN 1 THEN 'Campana de Vidrio' WHEN 2 THEN 'Fracción Seca' WHEN 3 THEN 'FRACCION HUMEDA'"
    " WHEN 4 THEN 'Punto Verde' ELSE p_name END"
)


def _waste_name():
    k = F.col("p_partkey") % 6
    return (
        F.when(k == 0, "organico").when(k == 1, "Campana de Vidrio").when(k == 2, "Fracción Seca")
        .when(k == 3, "FRACCION HUMEDA").when(k == 4, "Punto Verde").otherwise(F.col("p_name"))
    )


@query(
    "b10_waste_demand_factor",
    f"SELECT id, CASE WHEN w = 'organico' THEN 1.3e0 WHEN l LIKE '%vidrio%' THEN 0.4e0 WHEN l LIKE '%recicl%' OR l LIKE '%seca%' OR l LIKE '%verde%' THEN 0.7e0"
    f" WHEN l LIKE '%humed%' OR l LIKE '%húmed%' THEN 1.1e0 ELSE 1e0 END AS factor FROM (SELECT p_partkey AS id, {_WASTE_NAMES} AS w, lower({_WASTE_NAMES}) AS l FROM part)",
)
def _b10(spark, sf):
    factors = {"organico": 1.3, "vidrio": 0.4, "reciclables": 0.7, "residuos_humedos": 1.1}
    return a.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), levels.waste_factor(_waste_name(), factors).alias("factor"))


def parcels(spark, sf):
    """Parts as surveyed parcels: use codes, floors and a neighbourhood."""
    k = F.col("p_partkey")
    return a.table(spark, sf, "part").select(
        k.alias("id"),
        F.element_at(F.array(*[F.lit(v) for v in ("RESIDENCIAL", "UNICOMERCIAL", "OFICINAS", "INDUSTRIAL", "RESIDENCIAL", "BALDIO")]), (k % 6 + 1).cast("int")).alias("tipo1"),
        F.element_at(F.array(*[F.lit(v) for v in ("MULTIFAMILIAR", "UNIFAMILIAR", "", "x")]), (k % 4 + 1).cast("int")).alias("tipo2"),
        F.when(k % 10 == 9, ">10").when(k % 10 == 8, "3+").otherwise((k % 7).cast("string")).alias("pisos"),
        (F.col("p_size") % 25).cast("bigint").alias("zone"),
    )


CTES["parcels"] = (
    (),
    "SELECT p_partkey AS id, list_extract(['RESIDENCIAL', 'UNICOMERCIAL', 'OFICINAS', 'INDUSTRIAL', 'RESIDENCIAL', 'BALDIO'], p_partkey % 6 + 1) AS tipo1,"
    " list_extract(['MULTIFAMILIAR', 'UNIFAMILIAR', '', 'x'], p_partkey % 4 + 1) AS tipo2,"
    " CASE WHEN p_partkey % 10 = 9 THEN '>10' WHEN p_partkey % 10 = 8 THEN '3+' ELSE CAST(p_partkey % 7 AS VARCHAR) END AS pisos,"
    " CAST(p_size % 25 AS BIGINT) AS zone FROM part",
)
PARCEL_CATEGORY = (
    "CASE WHEN tipo1 IN ('RESIDENCIAL', 'BARRIO POPULAR') THEN CASE WHEN tipo2 = 'MULTIFAMILIAR' THEN 'residential_multifamily'"
    " WHEN tipo2 = 'UNIFAMILIAR' THEN 'residential_singlefamily' WHEN coalesce(TRY_CAST(pisos AS INTEGER), 0) > 2 OR pisos LIKE '>%' OR pisos LIKE '%+%'"
    " THEN 'residential_multifamily' ELSE 'residential_singlefamily' END"
    " WHEN tipo1 IN ('UNICOMERCIAL', 'MULTICOMERCIAL', 'GARAGE COMERCIAL', 'ESTACION DE SERVICIO') THEN 'commercial'"
    " WHEN tipo1 IN ('OFICINAS', 'EQUIPAMIENTO') THEN 'office' WHEN tipo1 = 'INDUSTRIAL' THEN 'industrial' ELSE 'other' END"
)


@query("b11_parcel_land_use", with_ctes("parcels", f"SELECT id, {PARCEL_CATEGORY} AS category FROM parcels"))
def _b11(spark, sf):
    return parcels(spark, sf).select("id", filters.parcel_category(F.col("tipo1"), F.col("tipo2"), F.col("pisos")).alias("category"))


_ZONE_SQL = (
    "CASE WHEN ind > 25 THEN 'industrial' WHEN off > 15 THEN 'office' WHEN com > 30 THEN 'commercial' WHEN mul > 35 AND mul >= sin THEN 'residential_multifamily'"
    " WHEN sin > 35 AND sin > mul THEN 'residential_singlefamily' WHEN mul + sin > 40 THEN CASE WHEN mul >= sin THEN 'residential_multifamily'"
    " ELSE 'residential_singlefamily' END ELSE 'mixed' END"
)


@query(
    "b12_zone_type",
    f"SELECT id, {_ZONE_SQL} AS zone_type FROM (SELECT p_partkey AS id, p_partkey % 51 AS mul, p_partkey % 47 AS sin, p_partkey % 37 AS com, p_partkey % 19 AS off, p_partkey % 31 AS ind FROM part)",
)
def _b12(spark, sf):
    k = F.col("p_partkey")
    return a.table(spark, sf, "part").select(k.alias("id"), filters.zone_type(k % 51, k % 47, k % 37, k % 19, k % 31).alias("zone_type"))


@query(
    "b13_recyclable",
    f"SELECT p_partkey AS id, regexp_matches(lower({_WASTE_NAMES}) || ' ' || lower(p_type), 'seca|recicl|verde|vidrio') AS recyclable FROM part",
)
def _b13(spark, sf):
    return a.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), levels.is_recyclable(_waste_name(), F.col("p_type")).alias("recyclable"))


@query(
    "b14_quality_report",
    with_ctes(
        "measurements",
        f"SELECT measurements, avg_fill_level_pct, max_fill_level_pct, bad_levels, bad_distances, list_filter([CASE WHEN bad_levels > 0 THEN 'level_out_of_range' END,"
        " CASE WHEN bad_distances > 0 THEN 'negative_distance' END], lambda x: x IS NOT NULL) AS errors, bad_levels = 0 AND bad_distances = 0 AS ok FROM ("
        f"SELECT count(*) AS measurements, {half_even('avg(fill_level_pct)', 4)} AS avg_fill_level_pct, max(fill_level_pct) AS max_fill_level_pct,"
        " count(*) FILTER (fill_level_pct < 0 OR fill_level_pct > 100) AS bad_levels, count(*) FILTER (ultrasonic_distance_cm < 0) AS bad_distances FROM measurements)",
    ),
)
def _b14(spark, sf):
    return filters.quality_report(measurements(spark, sf))


@query(
    "b15_point_lookup",
    with_ctes(
        "live_sites active",
        "SELECT 'red|' || c_custkey AS raw_id, s.id, 'site' AS kind FROM customer JOIN live_sites s ON s.id = c_custkey"
        " UNION ALL SELECT 'red|' || c_custkey, c.id, 'container' FROM customer LEFT JOIN live_sites s ON s.id = c_custkey JOIN active c ON c.id = c_custkey WHERE s.id IS NULL"
        " UNION ALL SELECT 'red|' || c_custkey, c.id, 'container' FROM customer LEFT JOIN live_sites s ON s.id = c_custkey LEFT JOIN active d ON d.id = c_custkey"
        " JOIN active c ON c.serie_id = 'red|' || c_custkey WHERE s.id IS NULL AND d.id IS NULL",
    ),
)
def _b15(spark, sf):
    ids = a.table(spark, sf, "customer").select(F.concat(F.lit("red|"), "c_custkey").alias("raw_id"))
    return filters.lookup(a.sites(spark, sf), a.containers(spark, sf), ids).select("raw_id", "id", "kind")


@query(
    "c01_site_container_waste",
    with_ctes(
        "live_sites active waste_types",
        "SELECT s.id AS site_id, c.id AS container_id, c.current_level, w.name AS waste_type_name FROM live_sites s LEFT JOIN active c ON c.site_id = s.id LEFT JOIN waste_types w ON w.id = s.waste_type_id",
    ),
)
def _c01(spark, sf):
    rows = network.site_containers(a.sites(spark, sf), a.containers(spark, sf), a.waste_types(spark))
    return rows.select("site_id", "container_id", "current_level", "waste_type_name")


@query(
    "c02_container_enrichment",
    with_ctes(
        "active sites neighborhoods container_types",
        "SELECT c.id, t.name AS type_name, t.volume_m3, CASE c.container_type_id WHEN 4 THEN 'Fracción Seca' ELSE 'Fracción Húmeda' END AS waste_kinds,"
        f" n.name AS neighborhood, s.name AS site_name, CAST(c.site_id AS VARCHAR) AS effective_site_id {_SEARCH_FROM}",
    ),
)
def _c02(spark, sf):
    return _enriched(spark, sf).select(
        "id", F.col("container_type.name").alias("type_name"), F.col("container_type.volume_m3").alias("volume_m3"),
        F.array_join(F.transform("container_type.waste_types", lambda w: w["name"]), ",").alias("waste_kinds"),
        "neighborhood", "site_name", "effective_site_id",
    )


@query(
    "c03_identity_resolution",
    with_ctes(
        "containers",
        "SELECT m.id, coalesce(c1.id, c2.id, c3.id) AS container_id FROM (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'x|' || user_id WHEN 1 THEN CAST(5000 + user_id AS VARCHAR)"
        " WHEN 2 THEN 'zz' ELSE 'none|9999999' END AS raw, CASE WHEN event_id % 4 = 2 THEN 'imei-' || user_id ELSE 'unknown' END AS dev FROM events) m"
        " LEFT JOIN containers c1 ON CAST(c1.id AS VARCHAR) = split_part(m.raw, '|', -1) LEFT JOIN containers c2 ON split_part(c2.serie_id, '|', -1) = split_part(m.raw, '|', -1)"
        " LEFT JOIN containers c3 ON c3.device_imei = m.dev",
    ),
)
def _c03(spark, sf):
    k = F.col("event_id")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("x|"), "user_id")).when(k % 4 == 1, (F.col("user_id") + 5000).cast("string"))
        .when(k % 4 == 2, "zz").otherwise("none|9999999")
    )
    device = F.when(k % 4 == 2, F.concat(F.lit("imei-"), "user_id")).otherwise("unknown")
    t = a.table(spark, sf, "events").select(k.alias("id"), raw.alias("raw_container_id"), device.alias("device_id"))
    return network.resolve_identity(t, a.containers(spark, sf)).select("id", "container_id")


AS_OF = "2024-01-15 12:00:00"


@query(
    "c05_as_of_level",
    with_ctes("readings", f"SELECT container_id, arg_max(level, (reading_date, id)) AS level FROM readings WHERE reading_date <= TIMESTAMP '{AS_OF}' GROUP BY container_id"),
)
def _c05(spark, sf):
    return network.latest_levels(a.readings(spark, sf), F.expr(f"timestamp_ntz'{AS_OF}'"))


@query(
    "c05_as_of_join",
    with_ctes(
        "readings",
        "SELECT m.container_id, m.moment, r.level FROM (SELECT o_orderkey % (SELECT 1 + max(user_id) FROM events) AS container_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * CAST(o_custkey * 29 % 43200 AS INTEGER) AS moment"
        " FROM orders GROUP BY ALL) m ASOF JOIN (SELECT container_id, reading_date, arg_max(level, id) AS level FROM readings GROUP BY ALL) r ON r.container_id = m.container_id AND r.reading_date <= m.moment",
    ),
)
def _c05j(spark, sf):
    users = a.table(spark, sf, "events").agg((F.max("user_id") + 1).alias("users"))
    o = attach(a.table(spark, sf, "orders"), users)
    moments = o.select(
        (F.col("o_orderkey") % F.col("users")).alias("container_id"),
        times.plus_minutes(F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.col("o_custkey") * 29 % 43200).alias("moment"),
    )
    return network.latest_level_at(a.readings(spark, sf), moments)


@query(
    "c06_sites_of_interest",
    with_ctes(
        "live_sites active readings",
        "SELECT s.id AS site_id, count(*) AS containers FROM live_sites s JOIN active c ON c.site_id = s.id GROUP BY s.id HAVING count(*) >= 2 OR s.id IN (SELECT c.site_id FROM readings r JOIN active c ON c.id = r.container_id"
        " WHERE r.reading_date BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND r.level >= 80)",
    ),
)
def _c06(spark, sf):
    window = (F.expr("timestamp_ntz'2024-01-10 00:00:00'"), F.expr("timestamp_ntz'2024-01-12 00:00:00'"))
    return network.sites_of_interest(a.sites(spark, sf), a.containers(spark, sf), a.readings(spark, sf), *window).select("site_id", "containers")


# The transfer stations.
STATIONS = [("COLEGIALES", -34.5772, -58.4451), ("FLORES", -34.6521, -58.4231), ("SOLDATI", -34.6720, -58.4550)]


@query(
    "c21_nearest_station",
    with_ctes(
        "active",
        "SELECT id, arg_min(place, (d, k)) AS nearest_place FROM (SELECT id, place, k, pow((latitude - y) * 111000e0, 2) + pow((longitude - x) * 91400e0, 2) AS d FROM active,"
        " (VALUES ('COLEGIALES', -34.5772e0, -58.4451e0, 0), ('FLORES', -34.6521e0, -58.4231e0, 1), ('SOLDATI', -34.6720e0, -58.4550e0, 2)) p(place, y, x, k)) GROUP BY id",
    ),
)
def _c21(spark, sf):
    return network.nearest_fixed(filters.active(a.containers(spark, sf)), STATIONS).select("id", "nearest_place")


_KPI_SQL = (
    f"SELECT count(*) AS total_sites, CAST(coalesce(sum(container_count), 0) AS BIGINT) AS total_containers, {half_even('avg(avg_level)', 2)} AS mean_fill_level,"
    f" {half_even('sqrt(greatest(0, avg(avg_level * avg_level) - avg(avg_level) * avg(avg_level)))', 2)} AS std_fill_level, count(*) FILTER (avg_level >= 80) AS critical_count,"
    " count(*) FILTER (avg_level >= 70 AND avg_level < 80) AS high_count, count(*) FILTER (avg_level >= 40 AND avg_level < 70) AS normal_count,"
    " count(*) FILTER (avg_level > 0 AND avg_level < 40) AS low_count, count(*) FILTER (avg_level <= 0) AS idle_count FROM {}"
)


def kpis(spark, sf):
    return network.network_kpis(network.site_levels(a.sites(spark, sf), filters.active(a.containers(spark, sf))))


@query("d01_network_kpis", with_ctes("site_levels", _KPI_SQL.format("site_levels")))
def _d01(spark, sf):
    return kpis(spark, sf)


@query(
    "d03_critical_and_full",
    with_ctes("site_levels", "SELECT (SELECT count(*) FROM site_levels WHERE avg_level >= 80) AS critical_sites, (SELECT count(*) FROM active WHERE current_level >= 100) AS full_containers"),
)
def _d03(spark, sf):
    c = filters.active(a.containers(spark, sf))
    return network.critical_and_full(network.site_levels(a.sites(spark, sf), c), c)


@query(
    "d04_container_stats",
    with_ctes(
        "active",
        "SELECT count(*) AS total, count(*) FILTER (available) AS available, count(*) FILTER (current_level >= 80) AS alert_level, CAST(round_even(avg(current_level), 0) AS INTEGER) AS avg_fill FROM active",
    ),
)
def _d04(spark, sf):
    return network.container_stats(a.containers(spark, sf))


@query(
    "d07_site_clusters",
    with_ctes(
        "live_sites active",
        f"SELECT {half_up('avg(s.latitude)', 6)} AS cluster_lat, {half_up('avg(s.longitude)', 6)} AS cluster_lng, count(c.id) AS container_count, CAST(coalesce({half_up('avg(c.current_level)', 0)}, 0) AS INTEGER) AS avg_level,"
        " coalesce(max(c.current_level), 0) AS max_level, count(*) FILTER (c.available) AS available_count FROM live_sites s LEFT JOIN active c ON c.site_id = s.id"
        " GROUP BY round(s.latitude / 15e-3), round(s.longitude / 15e-3)",
    ),
)
def _d07(spark, sf):
    rows = network.site_containers(a.sites(spark, sf), a.containers(spark, sf), a.waste_types(spark))
    c = network.site_clusters(rows, 13)
    return c.select(
        numbers.half_up(F.col("cluster_lat"), 6).alias("cluster_lat"), numbers.half_up(F.col("cluster_lng"), 6).alias("cluster_lng"),
        "container_count", "avg_level", "max_level", "available_count",
    )


@query(
    "d07_container_clusters",
    with_ctes(
        "active",
        f"SELECT {half_up('avg(latitude)', 6)} AS latitude, {half_up('avg(longitude)', 6)} AS longitude, count(*) AS total, CAST({half_up('avg(current_level)', 0)} AS INTEGER) AS avg_level"
        " FROM active GROUP BY round(latitude / 5e-2), round(longitude / 5e-2)",
    ),
)
def _d07c(spark, sf):
    c = network.container_clusters(a.containers(spark, sf), 12)
    return c.select(numbers.half_up(F.col("latitude"), 6).alias("latitude"), numbers.half_up(F.col("longitude"), 6).alias("longitude"), "total", "avg_level")


@query(
    "d08_site_states",
    with_ctes(
        "live_sites active",
        f"SELECT s.id AS site_id, CAST(coalesce({half_up('avg(c.current_level)', 0)}, 0) AS INTEGER) AS current_level, count(c.id) AS container_count, max(c.last_reading) AS last_reading,"
        " max(c.last_pickup) AS last_pickup, coalesce(bool_or(c.available), true) AS available, coalesce(string_agg(c.id || ':' || c.current_level, ',' ORDER BY c.id), '') AS containers"
        " FROM live_sites s LEFT JOIN active c ON c.site_id = s.id GROUP BY s.id",
    ),
)
def _d08(spark, sf):
    s = network.site_states(a.sites(spark, sf), a.containers(spark, sf), a.waste_types(spark))
    listed = F.array_join(F.transform("containers", lambda c: F.concat(c["id"].cast("string"), F.lit(":"), c["current_level"].cast("string"))), ",")
    return s.select("site_id", "current_level", "container_count", "last_reading", "last_pickup", "available", listed.alias("containers"))


@query(
    "d09_site_level_history",
    with_ctes(
        "readings active",
        f"SELECT c.site_id, r.reading_date, {half_up('avg(r.level)', 2)} AS avg_level, max(r.level) AS max_level, min(r.level) AS min_level, count(*) AS measurement_count"
        " FROM readings r JOIN active c ON c.id = r.container_id WHERE r.reading_date <= TIMESTAMP '2024-01-20' GROUP BY c.site_id, r.reading_date"
        " QUALIFY row_number() OVER (PARTITION BY c.site_id ORDER BY r.reading_date DESC) <= 24",
    ),
)
def _d09(spark, sf):
    return network.site_level_history(a.readings(spark, sf), a.containers(spark, sf), 24, F.expr("timestamp_ntz'2024-01-20 00:00:00'"))


@query(
    "d30_map_extent",
    with_ctes(
        "live_sites waste_types",
        f"SELECT min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lng_min, max(longitude) AS lng_max, {half_up('avg(latitude)', 6)} AS center_lat, {half_up('avg(longitude)', 6)} AS center_lng,"
        " count(*) AS entities, bool_or(lower(coalesce(w.name, 'húmeda')) LIKE '%húmed%') AS has_organico, bool_or(lower(coalesce(w.name, 'húmeda')) LIKE '%seca%') AS has_reciclaje"
        f" FROM {_WASTE_JOIN}",
    ),
)
def _d30(spark, sf):
    e = network.map_extent(a.sites(spark, sf), a.containers(spark, sf), a.waste_types(spark))
    return e.withColumn("center_lat", numbers.half_up(F.col("center_lat"), 6)).withColumn("center_lng", numbers.half_up(F.col("center_lng"), 6))


@query(
    "e08_change_feed",
    with_ctes("active", "SELECT id, change_version, current_level FROM active WHERE change_version > 5000 ORDER BY change_version, id LIMIT 40"),
)
def _e08(spark, sf):
    rows, _ = network.changes(a.containers(spark, sf), 5000, 40)
    return rows.select("id", "change_version", "current_level")


@query(
    "e08_change_cursor",
    with_ctes(
        "active",
        "SELECT CASE WHEN n >= 40 THEN last_version ELSE (SELECT max(change_version) FROM active) END AS cursor, CASE WHEN n >= 40 THEN last_id END AS cursor_id, n AS returned, n >= 40 AS has_more"
        " FROM (SELECT count(*) AS n, max(change_version) AS last_version, arg_max(id, (change_version, id)) AS last_id FROM"
        " (SELECT change_version, id FROM active WHERE change_version > 5000 ORDER BY change_version, id LIMIT 40))",
    ),
)
def _e08c(spark, sf):
    return network.changes(a.containers(spark, sf), 5000, 40)[1]


@query(
    "e08_changed_sites",
    with_ctes("live_sites active", "SELECT id FROM live_sites WHERE id IN (SELECT site_id FROM active WHERE change_version > 9950)"),
)
def _e08s(spark, sf):
    return network.changed_sites(a.sites(spark, sf), a.containers(spark, sf), 9950).select("id")


_SHARED = "change_version // 500"


@query(
    "e08_feed_pages",
    with_ctes("active", f"SELECT id, {_SHARED} AS change_version FROM active WHERE {_SHARED} > 4 ORDER BY 2, 1 LIMIT 21"),
)
def _e08p(spark, sf):
    """Three pages in a row of a feed in which many containers share a version."""
    shared = a.containers(spark, sf).withColumn("change_version", F.expr("change_version div 500"))
    out, cursor, last = None, 4, None
    for _ in range(3):
        page, after = network.changes(shared, cursor, 7, last)
        out = page if out is None else out.unionByName(page)
        row = after.first()
        cursor, last = row.cursor, row.cursor_id
        if not row.has_more:
            break
    return out.select("id", "change_version")


@query(
    "e08_site_feed",
    with_ctes(
        "live_sites active",
        "SELECT s.id, max(c.change_version) AS change_version FROM live_sites s JOIN active c ON c.site_id = s.id GROUP BY s.id HAVING max(c.change_version) > 5000 ORDER BY 2, 1 LIMIT 15",
    ),
)
def _e08f(spark, sf):
    return network.site_changes(a.sites(spark, sf), a.containers(spark, sf), 5000, 15)[0].select("id", "change_version")


@query("f01_page", with_ctes("active", "SELECT id, current_level FROM active ORDER BY id LIMIT 10 OFFSET 20"))
def _f01(spark, sf):
    return network.page(filters.active(a.containers(spark, sf)).select("id", "current_level"), 3, 10)


@query("f01_page_by_key", with_ctes("active", "SELECT id, current_level FROM active WHERE id > 25 ORDER BY id LIMIT 10"))
def _f01k(spark, sf):
    return network.page_after(filters.active(a.containers(spark, sf)).select("id", "current_level"), 25, 10)


@query("f02_last_instants", "SELECT ts AS reading_date, count(*) AS measurement_count FROM events GROUP BY ts ORDER BY ts DESC LIMIT 48")
def _f02(spark, sf):
    r = a.readings(spark, sf).groupBy("reading_date").agg(F.count("*").alias("measurement_count"))
    return r.orderBy(F.col("reading_date").desc()).limit(48).orderBy("reading_date")


@query(
    "h01_floor_to_interval",
    "SELECT event_id AS id, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, date_trunc('day', ts) + INTERVAL 1 MINUTE * CAST((hour(ts) * 60 + minute(ts)) // 50 * 50 AS INTEGER) AS odd FROM events",
)
def _h01(spark, sf):
    e = a.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), times.floor_to_interval(F.col("ts"), 15).alias("quarter"), times.floor_to_interval(F.col("ts"), 50).alias("odd"))


@query(
    "h02_ceil_to_next_interval",
    "SELECT event_id AS id, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS next_half_hour FROM events",
)
def _h02(spark, sf):
    e = a.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), times.ceil_to_next_interval(F.col("ts"), 30).alias("next_half_hour"))


@query(
    "h03_haversine",
    with_ctes("active", f"SELECT id, {half_up(haversine('latitude', 'longitude', '-34.6037e0', '-58.3816e0'), 6)} AS km FROM active"),
)
def _h03(spark, sf):
    c = filters.active(a.containers(spark, sf))
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(-34.6037), F.lit(-58.3816))
    return c.select("id", numbers.half_up(km, 6).alias("km"))


@query(
    "h04_flat_distances",
    with_ctes(
        "active",
        f"SELECT id, {half_up('sqrt(pow((-34.6037e0 - latitude) * 111000e0, 2) + pow((-58.3816e0 - longitude) * 111000e0 * cos(radians((latitude - 34.6037e0) / 2)), 2))', 4)} AS street_m,"
        f" {half_up('111320e0 * greatest(1e-2, cos(radians(latitude)))', 4)} AS metres_per_lon, {half_up('6371e0 * radians(longitude) * cos(radians(-34.6e0))', 6)} AS x_km,"
        f" {half_up('6371e0 * radians(latitude)', 6)} AS y_km FROM active",
    ),
)
def _h04(spark, sf):
    c = filters.active(a.containers(spark, sf))
    lat, lon = F.col("latitude"), F.col("longitude")
    x, y = geo.planar_km(lat, lon, F.lit(-34.6))
    return c.select(
        "id", numbers.half_up(geo.street_metres(lat, lon, F.lit(-34.6037), F.lit(-58.3816)), 4).alias("street_m"),
        numbers.half_up(geo.metres_per_degree(lat)[1], 4).alias("metres_per_lon"),
        numbers.half_up(x, 6).alias("x_km"), numbers.half_up(y, 6).alias("y_km"),
    )


_STOP = ", ".join("'" + w + "'" for w in text.ADDRESS_NOISE)


@query(
    "h06_address_parse",
    "SELECT id, CAST(nullif(regexp_extract(t, '\\b(\\d{1,5})\\b', 1), '') AS INTEGER) AS number, nullif(array_to_string(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(t, '\\b\\d{1,5}\\b', ' ', 'g'),"
    f" '[^A-Z0-9_ÁÉÍÓÚÑ°\\s]|°', ' ', 'g')), '\\s+'), lambda w: w NOT IN ({_STOP}) AND length(w) > 1), ' '), '') AS street"
    " FROM (SELECT p_partkey AS id, upper(CASE p_partkey % 3 WHEN 0 THEN 'Sitio RSU - ' || p_name || ' ' || p_size * 31 WHEN 1 THEN 'Av. de ' || p_name || ', ' || (p_size + 100) ELSE p_name || ' s/n' END) AS raw FROM part),"
    " LATERAL (SELECT CASE WHEN contains(raw, '-') THEN trim(substr(raw, strpos(raw, '-') + 1)) ELSE raw END AS t)",
)
def _h06(spark, sf):
    k = F.col("p_partkey") % 3
    raw = (
        F.when(k == 0, F.concat(F.lit("Sitio RSU - "), "p_name", F.lit(" "), F.col("p_size") * 31))
        .when(k == 1, F.concat(F.lit("Av. de "), "p_name", F.lit(", "), F.col("p_size") + 100))
        .otherwise(F.concat("p_name", F.lit(" s/n")))
    )
    return a.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), text.street_number(raw).alias("number"), text.street_name(raw).alias("street")
    )


@query(
    "h07_fold_names",
    "SELECT id, strip_accents(lower(trim(raw))) AS neighbourhood, CASE WHEN n = 'CURAPALIGU' THEN 'CURAPALIGUE' ELSE n END AS street FROM (SELECT id, raw, trim(regexp_replace(regexp_replace(upper(strip_accents(raw)), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS n"
    " FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN ' Núñez ' || p_name WHEN 1 THEN 'Curapaligü' WHEN 2 THEN p_name || ', José' ELSE upper(p_name) END AS raw FROM part)),"
    " LATERAL (SELECT n AS n2)",
)
def _h07(spark, sf):
    k = F.col("p_partkey") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit(" Núñez "), "p_name")).when(k == 1, "Curapaligü")
        .when(k == 2, F.concat("p_name", F.lit(", José"))).otherwise(F.upper("p_name"))
    )
    return a.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), text.neighbourhood_key(raw).alias("neighbourhood"), text.normal_name(raw).alias("street")
    )


@query("h08_repair_letter", "SELECT p_partkey AS id, replace(replace(p_name, 'r', '±'), '±', 'ñ') AS fixed FROM part")
def _h08(spark, sf):
    broken = F.replace(F.col("p_name"), F.lit("r"), F.lit("±"))
    return a.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.repair_enie(broken).alias("fixed"))


@query(
    "h09_id_suffix",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS parsed FROM customer",
)
def _h09(spark, sf):
    raw = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("a|b"), "c_custkey")).otherwise(F.concat(F.lit("a|b| "), "c_custkey", F.lit(" ")))
    return a.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text.numeric_suffix(raw).alias("parsed"))


@query(
    "h14_json_build_extract",
    with_ctes("readings", "SELECT id, level, collected, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM readings JOIN (SELECT event_id, props FROM events) e ON e.event_id = readings.id"),
)
def _h14(spark, sf):
    e = a.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k bigint").alias("p"))
    built = a.readings(spark, sf).select("id", F.to_json(F.struct("level", "collected")).alias("j"))
    back = built.join(e, "id").select("id", F.from_json("j", "level int, collected boolean").alias("b"), "p")
    return back.select("id", "b.level", "b.collected", "p.k")


@query(
    "g01_missing_sites",
    with_ctes("live_sites active", "SELECT id FROM live_sites WHERE id NOT IN (SELECT site_id FROM active)"),
)
def _g01(spark, sf):
    s = filters.active(a.sites(spark, sf)).select("id")
    return s.join(filters.active(a.containers(spark, sf)).select("site_id"), F.col("id") == F.col("site_id"), "left_anti")


@query(
    "g02_source_union",
    with_ctes("active", "SELECT id, 'negro' AS source FROM active WHERE container_type_id <> 4 UNION ALL SELECT id, 'verde' FROM active WHERE container_type_id = 4"),
)
def _g02(spark, sf):
    c = filters.active(a.containers(spark, sf))
    black = c.where(F.col("container_type_id") != 4).select("id", F.lit("negro").alias("source"))
    green = c.where(F.col("container_type_id") == 4).select("id", F.lit("verde").alias("source"))
    return black.unionByName(green)
