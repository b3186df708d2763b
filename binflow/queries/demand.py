"""Checks of demand allocation, land use, zone curves and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow import adapter as a
from binflow.functions.numbers import half_up as up
from binflow.operators import filters, territory
from binflow.plans import demand
from binflow.queries.duck import add_cte, half_even, half_up, with_ctes
from binflow.queries.network import PARCEL_CATEGORY, _ZONE_SQL, parcels
from binflow.queries.registry import query


def tracts(spark, sf):
    """Suppliers as census tracts of five districts."""
    k = F.col("s_suppkey")
    return a.table(spark, sf, "supplier").select(
        k.cast("string").alias("radio_code"), (k % 9 * 40).alias("population"), F.concat(F.lit("Comuna "), k % 5).alias("department_name")
    )


def links(spark, sf):
    """Part-supplier pairs of the line items as tract-container links with a weight."""
    li = a.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.select(
        F.col("l_suppkey").cast("string").alias("radio_code"), F.col("l_partkey").alias("container_id"),
        F.when(F.col("l_suppkey") % 6 == 0, F.lit(0.0)).otherwise((F.col("l_partkey") % 18).cast("double")).alias("weight"),
    )


def bins(spark, sf):
    p = a.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.lit(1.0) + F.col("p_size") % 4).alias("volume_m3"))


add_cte("tracts", "", "SELECT CAST(s_suppkey AS VARCHAR) AS radio_code, s_suppkey % 9 * 40 AS population, 'Comuna ' || (s_suppkey % 5) AS department_name FROM supplier")
add_cte(
    "links", "",
    "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS radio_code, l_partkey AS container_id, CASE WHEN l_suppkey % 6 = 0 THEN 0e0 ELSE CAST(l_partkey % 18 AS DOUBLE) END AS weight FROM lineitem",
)
add_cte("bins", "", "SELECT p_partkey AS id, 1e0 + p_size % 4 AS volume_m3 FROM part")
add_cte(
    "allocated", "links tracts",
    "SELECT l.*, t.population, t.department_name, n AS linked, t.population * 1.5e0 * CASE WHEN pool > 0 THEN weight / pool ELSE 1e0 / n END AS kg FROM links l JOIN (SELECT radio_code, sum(weight) AS pool, count(*) AS n FROM links GROUP BY 1) s USING (radio_code) JOIN tracts t USING (radio_code)",
)
add_cte(
    "bin_demand", "allocated bins",
    "SELECT b.id AS container_id, coalesce(h.radio_code, 'UNKNOWN') AS radio_code, coalesce(h.department_name, 'UNKNOWN') AS department_name, coalesce(codes, '') AS codes, coalesce(h.linked, 1) AS containers_in_radio,"
    f" {half_even('coalesce(daily, 150e0)', 4)} AS daily_waste_kg, {half_even('volume_m3 * 150', 2)} AS capacity_kg, {half_even('greatest(20e0, coalesce(daily, 150e0) / (volume_m3 * 150) * 100)', 4)} AS daily_fill_pct,"
    f" {half_even('greatest(20e0, coalesce(daily, 150e0) / (volume_m3 * 150) * 100) / 24', 4)} AS hourly_fill_pct FROM bins b LEFT JOIN (SELECT container_id, sum(kg) AS daily, arg_max({{'radio_code': radio_code, 'department_name': department_name, 'linked': linked}}, (kg, radio_code)) AS h,"
    " string_agg(DISTINCT radio_code, ',' ORDER BY radio_code) AS codes FROM allocated GROUP BY 1) d ON d.container_id = b.id",
)
_D = "container_id radio_code department_name containers_in_radio daily_waste_kg capacity_kg daily_fill_pct hourly_fill_pct".split()


def bin_demand(spark, sf):
    return demand.container_demand(demand.allocate(links(spark, sf), tracts(spark, sf)), bins(spark, sf))


@query("d24_container_demand", with_ctes("bin_demand", f"SELECT {', '.join(_D)}, codes FROM bin_demand"))
def _d24(spark, sf):
    return bin_demand(spark, sf).select(*_D, F.array_join("radio_codes", ",").alias("codes"))


@query(
    "d25_tract_summary",
    with_ctes(
        "links tracts",
        f"SELECT radio_code, department_name, population, n AS total_containers, {half_even('population * 1.5e0 / n', 4)} AS daily_waste_per_container_kg FROM tracts JOIN (SELECT radio_code, count(*) AS n FROM links GROUP BY 1) USING (radio_code)",
    ),
)
def _d25(spark, sf):
    return demand.tract_summary(links(spark, sf), tracts(spark, sf))


_EDGES = demand.HISTOGRAM_EDGES


@query(
    "d22_fill_histogram",
    with_ctes(
        "bin_demand",
        "SELECT CAST(b AS INTEGER) AS bin, (SELECT count(*) FROM bin_demand WHERE hourly_fill_pct >= lo AND hourly_fill_pct < hi) AS count FROM (VALUES "
        + ", ".join(f"({i}, {lo}e0, {hi})" for i, (lo, hi) in enumerate(zip(_EDGES, [f"{e}e0" for e in _EDGES[1:]] + ["CAST('inf' AS DOUBLE)"])))
        + ") v(b, lo, hi)",
    ),
)
def _d22h(spark, sf):
    return demand.histogram(bin_demand(spark, sf))


@query(
    "d22_distribution_stats",
    with_ctes(
        "bin_demand",
        f"SELECT count(*) AS n, {half_up('avg(hourly_fill_pct)', 6)} AS mean, max(hourly_fill_pct) AS max, list_extract(list(hourly_fill_pct ORDER BY hourly_fill_pct), CAST(floor(count(*) * 0.5e0) AS INTEGER) + 1) AS p50,"
        " list_extract(list(hourly_fill_pct ORDER BY hourly_fill_pct), CAST(floor(count(*) * 0.9e0) AS INTEGER) + 1) AS p90, list_extract(list(hourly_fill_pct ORDER BY hourly_fill_pct), CAST(floor(count(*) * 0.99e0) AS INTEGER) + 1) AS p99 FROM bin_demand",
    ),
)
def _d22(spark, sf):
    return demand.distribution_stats(bin_demand(spark, sf)).withColumn("mean", up(F.col("mean"), 6))


@query(
    "d23_district_rollup",
    with_ctes(
        "bin_demand tracts",
        f"SELECT department_name, container_count, avg_hourly, radio_count, population_total FROM (SELECT department_name, count(*) AS container_count, {half_even('avg(hourly_fill_pct)', 3)} AS avg_hourly FROM bin_demand GROUP BY 1)"
        " JOIN (SELECT department_name, count(*) AS radio_count, CAST(sum(population) AS BIGINT) AS population_total FROM tracts GROUP BY 1) USING (department_name)",
    ),
)
def _d23(spark, sf):
    return demand.district_rollup(bin_demand(spark, sf), tracts(spark, sf))


add_cte(
    "tract_rates", "links bin_demand tracts",
    f"SELECT radio_code, container_count, avg_hourly_pct, department_name, population FROM (SELECT l.radio_code, count(*) AS container_count, {half_even('avg(hourly_fill_pct)', 3)} AS avg_hourly_pct FROM links l JOIN bin_demand d USING (container_id) GROUP BY 1) JOIN tracts USING (radio_code)",
)


@query(
    "d23_hotspots",
    with_ctes(
        "tract_rates",
        "SELECT *, 'high' AS side FROM (SELECT * FROM tract_rates ORDER BY avg_hourly_pct DESC, radio_code LIMIT 5) UNION ALL SELECT *, 'low' FROM (SELECT * FROM tract_rates ORDER BY avg_hourly_pct, radio_code DESC LIMIT 5)",
    ),
)
def _d23h(spark, sf):
    return demand.hotspots(demand.tract_rates(links(spark, sf), bin_demand(spark, sf), tracts(spark, sf)))


@query("d23_low_coverage", with_ctes("tract_rates", "SELECT radio_code, container_count FROM tract_rates WHERE container_count <= 560"))
def _d23l(spark, sf):
    r = demand.tract_rates(links(spark, sf), bin_demand(spark, sf), tracts(spark, sf))
    return demand.low_coverage(r, 560).select("radio_code", "container_count")


_W = {"mul": (1.10, 0.60), "sin": (0.95, 0.85), "com": (1.40, 1.20), "off": (0.85, 0.10), "ind": (0.65, 0.20)}
_USE = dict(zip(_W, demand.USES))
add_cte(
    "land_use", "parcels",
    f"SELECT *, {_ZONE_SQL} AS zone_type, "
    + half_even(" + ".join(f"{c} / 100 * {w[0]}e0" for c, w in _W.items()) + " + greatest(0e0, 100 - mul - sin - com - off - ind) / 100 * 0.5e0", 4)
    + " AS demand_multiplier, CASE WHEN mul + sin + com + off + ind > 0 THEN "
    + half_even(" + ".join(f"{c} / (mul + sin + com + off + ind) * {w[1]}e0" for c, w in _W.items()), 4)
    + " ELSE 0.75e0 END AS weekend_factor FROM (SELECT zone, count(*) AS total_parcelas, "
    + ", ".join(half_even(f"count(*) FILTER (category = '{_USE[c]}') / count(*) * 100", 2) + f" AS {c}" for c in _W)
    + f" FROM (SELECT zone, {PARCEL_CATEGORY} AS category FROM parcels) GROUP BY zone)",
)


def land_use(spark, sf):
    return demand.land_use(parcels(spark, sf), "zone")


@query(
    "d27_land_use",
    with_ctes(
        "land_use",
        "SELECT zone, total_parcelas, mul AS res_multifamily_pct, sin AS res_singlefamily_pct, com AS commercial_pct, off AS office_pct, ind AS industrial_pct, zone_type, demand_multiplier, weekend_factor FROM land_use",
    ),
)
def _d27(spark, sf):
    return land_use(spark, sf)


@query("h12_demand_and_weekend_factors", with_ctes("land_use", "SELECT zone, demand_multiplier, weekend_factor FROM land_use"))
def _h12(spark, sf):
    return land_use(spark, sf).select("zone", "demand_multiplier", "weekend_factor")


@query("d33_zone_counts", with_ctes("land_use", "SELECT zone_type, count(*) AS radios FROM land_use GROUP BY 1"))
def _d33(spark, sf):
    return demand.zone_counts(land_use(spark, sf))


@query(
    "d29_calibration",
    with_ctes("land_use", f"SELECT {half_up('CASE WHEN avg(demand_multiplier) BETWEEN 1.05e0 * 0.97e0 AND 1.05e0 * 1.03e0 THEN 1e0 ELSE 1.05e0 / avg(demand_multiplier) END', 6)} AS calibration FROM land_use"),
)
def _d29(spark, sf):
    return demand.calibration(land_use(spark, sf)).select(up(F.col("calibration"), 6).alias("calibration"))


def _curve_rows() -> str:
    return ", ".join(f"('{z}', {h}, {w}e0)" for z, m in demand.HOUR_WEIGHTS.items() for h, w in m.items())


def _factor_rows() -> str:
    return ", ".join(f"('{z}', {d}, {w}e0)" for z, m in demand.WEEKDAY_FACTORS.items() for d, w in m.items())


add_cte("hour_defs", "", f"SELECT * FROM (VALUES {_curve_rows()}) v(zone_type, h, w)")
add_cte(
    "hour_weights", "hour_defs",
    "SELECT zone_type, hour, CASE WHEN lo = hi THEN wlo ELSE wlo + (whi - wlo) * ((hour - lo) / CAST(hi - lo AS DOUBLE)) END AS weight FROM (SELECT z.zone_type, r.hour, max(d.h) FILTER (d.h <= r.hour) AS lo, arg_max(d.w, d.h) FILTER (d.h <= r.hour) AS wlo, min(d.h) FILTER (d.h >= r.hour) AS hi, arg_min(d.w, d.h) FILTER (d.h >= r.hour) AS whi"
    " FROM (SELECT DISTINCT zone_type FROM hour_defs) z, range(24) r(hour), (SELECT zone_type AS zt, h, w FROM hour_defs UNION ALL SELECT zone_type, h - 24, w FROM hour_defs UNION ALL SELECT zone_type, h + 24, w FROM hour_defs) d WHERE d.zt = z.zone_type GROUP BY ALL)",
)
add_cte(
    "week", "hour_weights",
    f"SELECT zone_type, weekday, hour, raw / avg(raw) OVER (PARTITION BY zone_type) AS value FROM (SELECT h.zone_type, d.weekday, h.hour, h.weight * coalesce(f.w, 1e0) AS raw FROM hour_weights h, range(7) d(weekday) LEFT JOIN (VALUES {_factor_rows()}) f(zone_type, weekday, w) ON f.zone_type = h.zone_type AND f.weekday = d.weekday)",
)
add_cte(
    "mixed", "week land_use",
    "SELECT l.zone, w.weekday, w.hour, sum(p.v / t.total * w.value) AS value FROM land_use l, LATERAL (SELECT unnest(['residential_multifamily', 'residential_singlefamily', 'commercial', 'office', 'industrial']) AS zt, unnest([mul * 1.10e0, sin * 0.95e0, com * 1.40e0, off * 0.85e0, ind * 0.65e0]) AS v) p,"
    " LATERAL (SELECT mul * 1.10e0 + sin * 0.95e0 + com * 1.40e0 + off * 0.85e0 + ind * 0.65e0 AS total) t JOIN week w ON w.zone_type = p.zt WHERE t.total > 0 GROUP BY ALL",
)


def _mixed(spark, sf):
    return demand.mixed_curves(land_use(spark, sf), demand.type_curves(spark), "zone")


@query(
    "e09_interpolated_hours",
    "SELECT zone, hour, " + half_up("CASE WHEN lo = hi THEN wlo ELSE wlo + (whi - wlo) * ((hour - lo) / CAST(hi - lo AS DOUBLE)) END", 6) + " AS weight FROM (SELECT z.zone, r.hour, max(d.h) FILTER (d.h <= r.hour) AS lo, arg_max(d.w, d.h) FILTER (d.h <= r.hour) AS wlo, min(d.h) FILTER (d.h >= r.hour) AS hi, arg_min(d.w, d.h) FILTER (d.h >= r.hour) AS whi"
    " FROM (SELECT DISTINCT user_id * 7 + isodow(ts) - 1 AS zone FROM events) z, range(24) r(hour), (SELECT user_id AS zt, h + 24 * s AS h, w FROM (SELECT user_id * 7 + isodow(ts) - 1 AS user_id, hour(ts) AS h, CAST(count(*) AS DOUBLE) AS w FROM events GROUP BY ALL), range(-1, 2) q(s)) d WHERE d.zt = z.zone GROUP BY ALL)",
)
def _e09(spark, sf):
    """All events; a user's weekday is a zone, so most hours are gaps."""
    e = a.table(spark, sf, "events").withColumn("user_id", F.col("user_id") * 7 + F.weekday("ts"))
    per = e.groupBy("user_id", F.hour("ts").alias("h")).agg(F.count("*").cast("double").alias("w"))
    curves = per.groupBy(F.col("user_id").alias("zone")).agg(F.map_from_entries(F.collect_list(F.struct("h", "w"))).alias("hour_weights"))
    return demand.fill_hours(curves, "zone").select("zone", "hour", up(F.col("weight"), 6).alias("weight"))


@query("e10_mixed_weekly_curves", with_ctes("mixed", f"SELECT zone, CAST(weekday AS INTEGER) AS weekday, CAST(hour AS INTEGER) AS hour, {half_up('value', 6)} AS value FROM mixed"))
def _e10(spark, sf):
    return _mixed(spark, sf).select("zone", "weekday", "hour", up(F.col("value"), 6).alias("value"))


_NOW = "2024-01-15 12:00:00"


@query(
    "e14_control_ramp",
    f"SELECT o_orderkey AS id, {half_up('CASE WHEN e <= b OR t >= e THEN g WHEN t <= b THEN s ELSE s + (g - s) * (epoch(t) - epoch(b)) / (epoch(e) - epoch(b)) END', 6)} AS multiplier FROM (SELECT o_orderkey, 1e0 AS s, 1e0 + o_custkey % 7 / 10e0 AS g, TIMESTAMP '1998-01-01' AS t, o_orderdate AS b, o_orderdate + INTERVAL 1 DAY * CAST(o_custkey % 400 AS INTEGER) AS e FROM orders)",
)
def _e14(spark, sf):
    from binflow.functions import times

    o = a.table(spark, sf, "orders")
    ends = times.plus_minutes(F.col("o_orderdate"), F.col("o_custkey") % 400 * 1440)
    m = demand.ramp(F.lit(1.0), 1 + F.col("o_custkey") % 7 / F.lit(10.0), F.expr("timestamp_ntz'1998-01-01 00:00:00'"), F.col("o_orderdate"), ends)
    return o.select(F.col("o_orderkey").alias("id"), up(m, 6).alias("multiplier"))


@query(
    "i25_profile_resolution",
    with_ctes(
        "land_use neighborhoods",
        "SELECT id, CASE WHEN r.zone IS NOT NULL THEN 'radio' WHEN z = 'commercial' THEN 'zone_type' WHEN b.key IS NOT NULL THEN 'barrio' ELSE 'default' END AS resolved_by, CASE WHEN r.zone IS NOT NULL THEN r.demand_multiplier WHEN z = 'commercial' THEN 1.4e0 WHEN b.key IS NOT NULL THEN b.m ELSE 1e0 END AS demand_multiplier"
        " FROM (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey % 40 AS VARCHAR) WHEN 1 THEN 'commercial' WHEN 2 THEN 'NATION_' || (c_custkey % 40) ELSE '?' END AS z FROM customer) q LEFT JOIN land_use r ON CAST(r.zone AS VARCHAR) = q.z LEFT JOIN (SELECT name AS key, 0.9e0 + id / 100e0 AS m FROM neighborhoods) b ON b.key = q.z",
    ),
)
def _i25(spark, sf):
    k = F.col("c_custkey")
    zone = F.when(k % 4 == 0, (k % 40).cast("string")).when(k % 4 == 1, "commercial").when(k % 4 == 2, F.concat(F.lit("nation_"), k % 40)).otherwise("?")
    zones = a.table(spark, sf, "customer").select(k.alias("id"), zone.alias("zone"))
    radios = land_use(spark, sf).select(F.col("zone").cast("string").alias("key"), "demand_multiplier", "zone_type")
    barrios = a.neighborhoods(spark, sf).select(F.col("name").alias("key"), (F.lit(0.9) + F.col("id") / 100.0).alias("demand_multiplier"), F.lit("mixed").alias("zone_type"))
    return demand.resolve_profiles(zones, radios, barrios).select("id", "resolved_by", "demand_multiplier")


@query(
    "i26_zone_multipliers",
    with_ctes(
        "mixed land_use",
        f"SELECT e.event_id AS id, {half_up('l.demand_multiplier * m.value * CASE WHEN avg_m BETWEEN 1.05e0 * 0.97e0 AND 1.05e0 * 1.03e0 THEN 1e0 ELSE 1.05e0 / avg_m END * CASE WHEN l.demand_multiplier > 0.95e0 THEN 1.2e0 ELSE 1e0 END', 6)} AS zone_mult FROM events e JOIN land_use l ON l.zone = e.user_id % 25 JOIN mixed m ON m.zone = l.zone AND m.weekday = isodow(e.ts) - 1 AND m.hour = hour(e.ts), (SELECT avg(demand_multiplier) AS avg_m FROM land_use)",
    ),
)
def _i26(spark, sf):
    lu = land_use(spark, sf).withColumnRenamed("zone", "key").withColumn("barrio", F.concat(F.lit("Zona "), "key"))
    e = a.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 25).alias("key"), F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")
    )
    over = lu.where(F.col("demand_multiplier") > 0.95).select(F.upper("barrio").alias("neighborhood"), F.lit(1.2).alias("multiplier"))
    m = demand.zone_multipliers(e, lu, _mixed(spark, sf).withColumnRenamed("zone", "key"), demand.calibration(lu), over)
    return m.select("id", up(F.col("zone_mult"), 6).alias("zone_mult"))


@query(
    "i27_overflow_spill",
    with_ctes(
        "active",
        "SELECT id, " + half_up("least(100e0, level + increment + coalesce(s.add, 0e0) + coalesce(t.add, 0e0))", 6) + " AS level FROM (SELECT id, site_id, id % 3 AS waste, CAST(current_level AS DOUBLE) AS level, 20e0 + id % 30 AS increment FROM active) c LEFT JOIN (SELECT o.to_site, o.waste, o.x / n.n AS add FROM (SELECT site_id + CASE WHEN site_id % 2 = 0 THEN 1 ELSE -1 END AS to_site, id % 3 AS waste,"
        " sum(CASE WHEN current_level >= 100 THEN 20e0 + id % 30 WHEN current_level + 20 + id % 30 > 100 THEN current_level + 20e0 + id % 30 - 100 ELSE 0e0 END) AS x FROM active GROUP BY ALL) o JOIN (SELECT site_id, id % 3 AS waste, count(*) AS n FROM active GROUP BY ALL) n ON n.site_id = o.to_site AND n.waste = o.waste) s ON s.to_site = c.site_id AND s.waste = c.waste"
        " LEFT JOIN (SELECT o.to_site, sum(o.x / n.n) AS add FROM (SELECT site_id + CASE WHEN site_id % 2 = 0 THEN 1 ELSE -1 END AS to_site, id % 3 AS waste, sum(CASE WHEN current_level >= 100 THEN 20e0 + id % 30 WHEN current_level + 20 + id % 30 > 100 THEN current_level + 20e0 + id % 30 - 100 ELSE 0e0 END) AS x FROM active GROUP BY ALL) o"
        " JOIN (SELECT site_id, count(*) AS n FROM active GROUP BY 1) n ON n.site_id = o.to_site WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.site_id = o.to_site AND a.id % 3 = o.waste) GROUP BY 1) t ON t.to_site = c.site_id",
    ),
)
def _i27(spark, sf):
    c = filters.active(a.containers(spark, sf)).select(
        "id", "site_id", (F.col("id") % 3).alias("waste_type"), F.col("current_level").cast("double").alias("level"), (F.lit(20.0) + F.col("id") % 30).alias("increment")
    )
    opp = c.select("site_id").distinct().withColumn("opposing_id", F.col("site_id") + F.when(F.col("site_id") % 2 == 0, 1).otherwise(-1))
    return demand.spill_over(c, opp).select("id", up(F.col("level"), 6).alias("level"))


def _stops(spark, sf):
    o = a.table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 97).alias("route_id"), F.col("o_orderkey").alias("site_id"), (F.col("o_orderkey") * 31 % 1009).alias("stop_order"))


@query(
    "i28_route_schedule",
    "SELECT route_id, site_id, position, list_extract([18, 20, 23, 2, 5], CAST(k AS INTEGER) + 1) AS hour FROM (SELECT o_custkey % 97 AS route_id, o_orderkey AS site_id, row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderkey * 31 % 1009, o_orderkey) - 1 AS position, count(*) OVER (PARTITION BY o_custkey % 97) AS n FROM orders), range(5) r(k)"
    " WHERE n <= 5 OR (position >= k * n // 5 AND position < (k + 1) * n // 5)",
)
def _i28(spark, sf):
    return demand.route_schedule(_stops(spark, sf), [20, 2, 18, 5, 23])


@query("i29_nearest_neighbour_order")
def _i29(spark, sf):
    s = a.table(spark, sf, "customer")
    k = F.col("c_custkey")
    stops = s.select((k % 60).alias("route_id"), k.alias("site_id"), (F.lit(-34.62) + k * 7919 % 101 * F.lit(0.0001)).alias("latitude"), (F.lit(-58.35) + k * 104729 % 103 * F.lit(0.0001)).alias("longitude"))
    return demand.nearest_neighbour_order(stops, (-34.61571, -58.35697))


@query(
    "i30_demand_listing",
    with_ctes(
        "neighborhoods",
        f"SELECT name, population, CASE WHEN population >= 5000 THEN {half_up('1e0 + 5e-1 * (epoch(TIMESTAMP ' + chr(39) + _NOW + chr(39) + ') - epoch(TIMESTAMP ' + chr(39) + '2024-01-10' + chr(39) + ')) / (10 * 86400)', 6)} ELSE 1e0 END AS multiplier_effective FROM neighborhoods",
    ),
)
def _i30(spark, sf):
    n = a.neighborhoods(spark, sf)
    over = n.where(F.col("population") >= 5000).select(
        F.col("name").alias("neighborhood"), F.lit(1.0).alias("multiplier_start"), F.lit(1.5).alias("multiplier_target"),
        F.expr("timestamp_ntz'2024-01-10 00:00:00'").alias("begins"), F.expr("timestamp_ntz'2024-01-20 00:00:00'").alias("ends"),
    )
    listing = demand.demand_listing(n, over, F.expr(f"timestamp_ntz'{_NOW}'"))
    return listing.select("name", "population", up(F.col("multiplier_effective"), 6).alias("multiplier_effective"))


@query(
    "i31_site_demand",
    with_ctes(
        "active",
        "SELECT coalesce(CAST(s AS VARCHAR), 'SITE-' || min(id)) AS site, arg_min(current_level, id) AS demand, arg_min(neighborhood_id, id) AS zone FROM (SELECT *, CASE WHEN id % 11 = 0 THEN NULL ELSE site_id END AS s, CASE WHEN id % 11 = 0 THEN id END AS own FROM active) GROUP BY s, own",
    ),
)
def _i31(spark, sf):
    c = filters.active(a.containers(spark, sf))
    return demand.site_demand(
        c.select("id", F.col("id").alias("seq"), F.when(F.col("id") % 11 != 0, F.col("site_id")).alias("site_id"), F.col("current_level").alias("demand"), F.col("neighborhood_id").alias("zone"))
    )


@query("c12_buffered_links")
def _c12(spark, sf):
    from binflow.queries.territory import polygons, spots

    tract = polygons(spark, sf).select(F.col("polygon_id").cast("string").alias("radio_code"), "rings")
    bins_at = spots(spark, sf).select("id", F.col("y").alias("latitude"), F.col("x").alias("longitude"))
    return territory.buffered_links(tract, bins_at, 30.0)
