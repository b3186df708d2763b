"""Checks of utilisation metrics, distance joins and both redistribution planners."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow import adapter as a
from binflow.functions.numbers import half_even as even
from binflow.functions.numbers import half_up as up
from binflow.operators import filters, history, readings as arrivals, spatial
from binflow.plans import overload, transport, utilisation
from binflow.plans.overload import OverloadConfig
from binflow.plans.utilisation import ScoreConfig
from binflow.queries.duck import add_cte, half_even, half_up, haversine, with_ctes
from binflow.queries.registry import query
from binflow.session import cut

CONFIG = ScoreConfig(0.37, 0.371, 0.372, 6.0)
OVERLOAD = OverloadConfig(max_distance_km=2.5, move_cost_hours_per_week=0.25, window_days=28)

add_cte(
    "reading_metrics",
    "readings",
    f"SELECT site_id, {half_up('avg(level)', 2)} AS avg_fill, {half_up('avg(CASE WHEN level >= 80 THEN 1e0 ELSE 0e0 END)', 4)} AS peak_rate, count(*) FILTER (level >= 100) AS overflow_count, count(*) AS reading_count"
    " FROM readings WHERE reading_date >= (SELECT max(reading_date) FROM readings) - INTERVAL 20 DAY GROUP BY site_id",
)
add_cte(
    "utilisation",
    "live_sites active reading_metrics",
    "SELECT *, CASE WHEN utilization_score >= 0.85e0 THEN 'critical' WHEN utilization_score >= 0.65e0 THEN 'high' WHEN utilization_score >= 0.35e0 THEN 'normal' WHEN utilization_score >= 0.15e0 THEN 'low' ELSE 'idle' END AS category FROM ("
    "SELECT s.id AS site_id, s.latitude, s.longitude, s.waste_type_id, c.container_type_id, coalesce(c.n, 0) AS container_count, CASE WHEN c.n > 0 THEN coalesce(m.avg_fill, c.cur, 0e0) ELSE 0e0 END AS avg_fill_level,"
    " CASE WHEN c.n > 0 THEN coalesce(m.peak_rate, 0e0) ELSE 0e0 END AS peak_fill_rate, CASE WHEN c.n > 0 THEN coalesce(m.overflow_count, 0) ELSE 0 END AS overflow_frequency,"
    f" CASE WHEN c.n > 0 THEN {half_even('least(coalesce(m.avg_fill, c.cur, 0e0) / 100, 1e0) * 0.4e0 + coalesce(m.peak_rate, 0e0) * 0.3e0 + least(coalesce(m.overflow_count, 0) / 50e0, 1e0) * 0.3e0', 4)} ELSE 0e0 END AS utilization_score"
    f" FROM live_sites s LEFT JOIN (SELECT site_id, count(*) AS n, min(container_type_id) AS container_type_id, {half_up('avg(current_level)', 0)} AS cur FROM active GROUP BY 1) c ON c.site_id = s.id LEFT JOIN reading_metrics m ON m.site_id = s.id)",
)


def metrics(spark, sf):
    return utilisation.utilisation(a.sites(spark, sf), a.containers(spark, sf), utilisation.reading_metrics(a.readings(spark, sf), 20))


def network_metrics(spark, sf):
    """Utilisation with larger sites (two to six containers), so that sites can give."""
    m = metrics(spark, sf).where(F.col("container_count") > 0)
    return m.withColumn("container_count", (F.col("site_id") % 5 + 2).cast("bigint")).withColumn(
        "max_containers", F.when(F.col("site_id") % 6 == 0, 4)
    )


add_cte(
    "network_metrics",
    "utilisation",
    "SELECT * REPLACE (CAST(site_id % 5 + 2 AS BIGINT) AS container_count), CASE WHEN site_id % 6 = 0 THEN 4 END AS max_containers FROM utilisation WHERE container_count > 0",
)
_U = "site_id container_count avg_fill_level peak_fill_rate overflow_frequency utilization_score category".split()


@query("d05_site_utilisation", with_ctes("utilisation", f"SELECT {', '.join(_U)} FROM utilisation"))
def _d05(spark, sf):
    return metrics(spark, sf).select(*_U)


@query(
    "d05_reading_metrics_long",
    with_ctes(
        "long_readings",
        f"SELECT site_id, {half_up('avg(level)', 2)} AS avg_fill, {half_up('avg(CASE WHEN level >= 80 THEN 1e0 ELSE 0e0 END)', 4)} AS peak_rate, count(*) FILTER (level >= 100) AS overflow_count, count(*) AS reading_count"
        " FROM long_readings WHERE reading_date >= (SELECT max(reading_date) FROM long_readings) - INTERVAL 1000 DAY GROUP BY site_id",
    ),
)
def _d05l(spark, sf):
    return utilisation.reading_metrics(a.long_readings(spark, sf), 1000)


@query(
    "d06_weighted_level_stats",
    with_ctes(
        "utilisation",
        f"SELECT {half_even('sum(container_count * avg_fill_level) / sum(container_count)', 2)} AS mean_fill_level, {half_even('sqrt(sum(container_count * pow(avg_fill_level - mu, 2)) / sum(container_count))', 2)} AS std_fill_level"
        " FROM utilisation, (SELECT sum(container_count * avg_fill_level) / sum(container_count) AS mu FROM utilisation)",
    ),
)
def _d06(spark, sf):
    return utilisation.weighted_level_stats(metrics(spark, sf), "avg_fill_level", "container_count")


@query(
    "c07_distance_join",
    with_ctes(
        "live_sites",
        f"SELECT d.id AS donor_id, r.id AS receiver_id, {half_up(haversine('d.latitude', 'd.longitude', 'r.latitude', 'r.longitude'), 6)} AS distance_km FROM live_sites d JOIN live_sites r ON d.load_side_category = 'DERECHA' AND r.load_side_category <> 'DERECHA'"
        f" AND d.waste_type_id IS NOT DISTINCT FROM r.waste_type_id AND {haversine('d.latitude', 'd.longitude', 'r.latitude', 'r.longitude')} <= 2.2e0",
    ),
)
def _c07(spark, sf):
    s = filters.active(a.sites(spark, sf))

    def side(prefix, right):
        return s.where((F.col("load_side_category") == "DERECHA") == right).select(
            F.col("id").alias(f"{prefix}_id"), F.col("latitude").alias(f"{prefix}_latitude"), F.col("longitude").alias(f"{prefix}_longitude"), "waste_type_id"
        )

    p = spatial.haversine_pairs(side("donor", True), side("receiver", False), 2.2, ("waste_type_id",))
    return p.select("donor_id", "receiver_id", up(F.col("distance_km"), 6).alias("distance_km"))


@query(
    "c08_planar_radius_join",
    with_ctes(
        "live_sites",
        "SELECT d.id AS donor_id, r.id AS receiver_id, " + half_up("sqrt(pow(d.x - r.x, 2) + pow(d.y - r.y, 2))", 6) + " AS distance_km FROM (SELECT *, 6371e0 * radians(longitude) * cos(radians(avg(latitude) OVER (PARTITION BY container_type_id))) AS x, 6371e0 * radians(latitude) AS y FROM live_sites) d"
        " JOIN (SELECT *, 6371e0 * radians(longitude) * cos(radians(avg(latitude) OVER (PARTITION BY container_type_id))) AS x, 6371e0 * radians(latitude) AS y FROM live_sites) r ON d.container_type_id = r.container_type_id AND d.id <> r.id AND sqrt(pow(d.x - r.x, 2) + pow(d.y - r.y, 2)) <= 2.0e0",
    ),
)
def _c08(spark, sf):
    s = filters.active(a.sites(spark, sf)).select(
        F.col("id").alias("site_id"), "latitude", "longitude", F.col("container_type_id").alias("group_key"), F.lit(True).alias("can_donate"), F.lit(True).alias("can_receive")
    )
    return spatial.planar_pairs(s, 2.0).select("donor_id", "receiver_id", up(F.col("distance_km"), 6).alias("distance_km"))


add_cte(
    "supply", "network_metrics",
    "SELECT site_id, supply FROM (SELECT site_id, container_count - CAST(greatest(1, ceil(container_count * avg_fill_level / 50e0)) AS BIGINT) AS supply FROM network_metrics WHERE utilization_score < 0.37e0 AND container_count > 1) WHERE supply > 0",
)
add_cte(
    "demand", "network_metrics",
    "SELECT site_id, demand FROM (SELECT site_id, CASE WHEN max_containers IS NULL THEN d ELSE least(d, greatest(0, max_containers - container_count)) END AS demand FROM (SELECT *, CAST(greatest(1, ceil(container_count * (utilization_score / 0.371e0 - 1))) AS BIGINT) AS d FROM network_metrics WHERE utilization_score >= 0.372e0)) WHERE demand > 0",
)
# The sequential greedy: edges in order, each taking what both ends still have.
add_cte(
    "edge_list", "supply demand network_metrics",
    "SELECT row_number() OVER (ORDER BY score DESC, receiver_id, distance_km, donor_id) AS rk, * FROM (SELECT d.site_id AS donor_id, r.site_id AS receiver_id, r.utilization_score AS score, "
    + haversine("d.latitude", "d.longitude", "r.latitude", "r.longitude")
    + " AS distance_km FROM (SELECT * FROM network_metrics SEMI JOIN supply USING (site_id)) d JOIN (SELECT * FROM network_metrics SEMI JOIN demand USING (site_id)) r ON d.waste_type_id IS NOT DISTINCT FROM r.waste_type_id AND d.container_type_id IS NOT DISTINCT FROM r.container_type_id) WHERE distance_km <= 6e0",
)
_GREEDY = with_ctes(
    "edge_list",
    "SELECT donor_id, receiver_id, amount FROM steps WHERE amount > 0",
).replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "\nSELECT donor_id, receiver_id, amount FROM steps",
    ",\nsteps AS (SELECT CAST(0 AS BIGINT) AS rk, CAST(0 AS BIGINT) AS donor_id, CAST(0 AS BIGINT) AS receiver_id, CAST(0 AS BIGINT) AS amount,"
    " (SELECT list(coalesce(q.supply, 0) ORDER BY i) FROM range((SELECT 1 + max(s_suppkey) FROM supplier)) r(i) LEFT JOIN supply q ON q.site_id = i) AS s,"
    " (SELECT list(coalesce(q.demand, 0) ORDER BY i) FROM range((SELECT 1 + max(s_suppkey) FROM supplier)) r(i) LEFT JOIN demand q ON q.site_id = i) AS d"
    " UNION ALL SELECT e.rk, e.donor_id, e.receiver_id, least(s[e.donor_id + 1], d[e.receiver_id + 1]),"
    " list_transform(s, lambda x, i: CASE WHEN i = e.donor_id + 1 THEN x - least(s[e.donor_id + 1], d[e.receiver_id + 1]) ELSE x END),"
    " list_transform(d, lambda x, i: CASE WHEN i = e.receiver_id + 1 THEN x - least(s[e.donor_id + 1], d[e.receiver_id + 1]) ELSE x END)"
    " FROM steps JOIN edge_list e ON e.rk = steps.rk + 1)"
    "\nSELECT donor_id, receiver_id, amount FROM steps",
)


@query("i08_donor_supply", with_ctes("supply", "SELECT site_id, supply FROM supply"))
def _i08(spark, sf):
    return utilisation.donor_supply(network_metrics(spark, sf), CONFIG).select("site_id", "supply")


@query("i08_receiver_demand", with_ctes("demand", "SELECT site_id, demand FROM demand"))
def _i08r(spark, sf):
    return utilisation.receiver_demand(network_metrics(spark, sf), CONFIG).select("site_id", "demand")


def _plan(spark, sf):
    m = cut(network_metrics(spark, sf))
    moves, supply, demand = utilisation.score_plan(m, CONFIG)
    if moves is None:
        moves = spark.createDataFrame([], "donor_id bigint, receiver_id bigint, distance_km double, score double, amount bigint")
    return m, moves, supply, demand


@query("i09_score_greedy_plan", _GREEDY)
def _i09(spark, sf):
    return _plan(spark, sf)[1].select("donor_id", "receiver_id", "amount")


@query("i10_transport_plan")
def _i10(spark, sf):
    m = cut(network_metrics(spark, sf))
    supply, demand = utilisation.donor_supply(m, CONFIG), utilisation.receiver_demand(m, CONFIG)
    plan = transport.transport_plan(
        utilisation.candidate_edges(supply, demand, CONFIG), supply.select(F.col("site_id").alias("donor_id"), "supply"),
        demand.select(F.col("site_id").alias("receiver_id"), "demand"), m.select("site_id", "latitude", "longitude"),
    )
    return plan.select("donor_id", "receiver_id", "amount")


_DONOR_AFTER = half_even("least(100, d.avg_fill_level * greatest(1, d.container_count) / greatest(1, greatest(1, d.container_count) - 1))", 1)
_RECEIVER_AFTER = half_even("least(100, r.avg_fill_level * greatest(1, r.container_count) / (greatest(1, r.container_count) + 1))", 1)
_D_BEFORE, _R_BEFORE = half_even("d.avg_fill_level", 1), half_even("r.avg_fill_level", 1)
_ASSIGNED = with_ctes("edge_list active", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + _GREEDY[_GREEDY.index(",\nsteps AS") : _GREEDY.index("\nSELECT donor_id, receiver_id, amount FROM steps WHERE")] + (
    ",\nsingle AS (SELECT e.donor_id, e.receiver_id, e.distance_km, row_number() OVER (PARTITION BY e.donor_id ORDER BY e.score DESC, e.receiver_id, e.distance_km, n) AS donor_rank FROM steps t JOIN edge_list e ON e.rk = t.rk, range(1, 1000) u(n) WHERE n <= t.amount)"
    f"\nSELECT s.donor_id, s.receiver_id, s.donor_rank, k.container_id, {half_even('s.distance_km', 4)} AS distance_km, {_D_BEFORE} AS donor_fill_before, {_DONOR_AFTER} AS donor_fill_after, {_R_BEFORE} AS receiver_fill_before, {_RECEIVER_AFTER} AS receiver_fill_after,"
    f" {half_even(half_even(f'{_RECEIVER_AFTER} - {_R_BEFORE}', 1) + ' + ' + half_even(f'{_DONOR_AFTER} - {_D_BEFORE}', 1), 1)} AS net_decongestion_pct"
    " FROM single s JOIN network_metrics d ON d.site_id = s.donor_id JOIN network_metrics r ON r.site_id = s.receiver_id JOIN (SELECT id AS container_id, site_id, row_number() OVER (PARTITION BY site_id ORDER BY current_level, id) AS n FROM active) k ON k.site_id = s.donor_id AND k.n = s.donor_rank"
)


@query("i15_assigned_moves", _ASSIGNED)
def _i15(spark, sf):
    m, moves, _, _ = _plan(spark, sf)
    ranks = arrivals.least_full_first(a.containers(spark, sf))
    return utilisation.move_effects(utilisation.assign_containers(moves, ranks), m).select(
        "donor_id", "receiver_id", "donor_rank", "container_id", "distance_km", "donor_fill_before", "donor_fill_after", "receiver_fill_before", "receiver_fill_after", "net_decongestion_pct",
    )


def _spread(level: str, weight: str) -> str:
    mean = f"sum({weight} * {level}) / sum({weight})"
    return f"{half_even(mean, 2)} AS m, {half_even(f'sqrt(greatest(0, sum({weight} * {level} * {level}) / sum({weight}) - pow({mean}, 2)))', 2)} AS s"


_SUMMARY = _GREEDY.replace(
    "\nSELECT donor_id, receiver_id, amount FROM steps WHERE amount > 0",
    ",\nmoved AS (SELECT e.donor_id, e.receiver_id, e.distance_km, t.amount FROM steps t JOIN edge_list e ON e.rk = t.rk WHERE t.amount > 0),"
    "\nafter AS (SELECT m.*, coalesce(g.n, 0) AS given, m.container_count - coalesce(g.n, 0) + coalesce(r.n, 0) AS nc FROM network_metrics m LEFT JOIN (SELECT donor_id AS site_id, sum(amount) AS n FROM moved GROUP BY 1) g ON g.site_id = m.site_id"
    " LEFT JOIN (SELECT receiver_id AS site_id, sum(amount) AS n FROM moved GROUP BY 1) r ON r.site_id = m.site_id),"
    "\nlevelled AS (SELECT CAST(nc AS DOUBLE) AS nc, least(100e0, greatest(0e0, avg_fill_level * container_count / nc)) AS nl FROM after WHERE nc > 0)"
    "\nSELECT CAST(a.total AS BIGINT) AS total_containers_moved, a.receivers AS sites_receiving, a.donors AS sites_donating, a.km AS avg_distance_km, (SELECT count(*) FROM after WHERE given > 0 AND given >= container_count) AS sites_emptied,"
    f" o.m AS original_mean_fill, o.s AS original_std_fill, n.m AS optimized_mean_fill, n.s AS optimized_std_fill, {half_even('least(coalesce(u.score, 0e0) * a.total / greatest(coalesce(w.wanted, 0), 1), 1e0)', 4)} AS expected_improvement"
    f" FROM (SELECT coalesce(sum(amount), 0) AS total, count(DISTINCT receiver_id) AS receivers, count(DISTINCT donor_id) AS donors, coalesce({half_even('sum(amount * ' + half_even('distance_km', 4) + ') / sum(amount)', 4)}, 0e0) AS km FROM moved) a,"
    f" (SELECT {_spread('avg_fill_level', 'container_count')} FROM network_metrics) o, (SELECT {_spread('nl', 'nc')} FROM levelled) n, (SELECT sum(demand) AS wanted FROM demand) w, (SELECT avg(utilization_score) AS score FROM network_metrics WHERE utilization_score >= 0.372e0) u",
)


@query("d31_plan_summary", _SUMMARY)
def _d31(spark, sf):
    m, moves, _, demand = _plan(spark, sf)
    return utilisation.plan_summary(moves, m, demand, CONFIG)


add_cte(
    "hourly",
    "readings active",
    f"SELECT a.site_id, date_trunc('hour', r.reading_date) AS timestamp, avg(r.level) AS level, bool_or(r.collected) AS collected FROM readings r JOIN active a ON a.id = r.container_id WHERE r.reading_date BETWEEN (SELECT max(reading_date) FROM readings) - INTERVAL 28 DAY AND (SELECT max(reading_date) FROM readings) GROUP BY ALL",
)
add_cte(
    "stretches",
    "hourly",
    "SELECT *, row_number() OVER (PARTITION BY site_id, stretch ORDER BY timestamp) AS position FROM (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY site_id ORDER BY timestamp) AS stretch FROM (SELECT *, p IS NULL OR collected OR "
    + half_even("greatest(0, p - level)", 2)
    + " >= 10 AS starts FROM (SELECT *, lag(level) OVER (PARTITION BY site_id ORDER BY timestamp) AS p FROM hourly)))",
)
add_cte("kinds", "stretches", "SELECT *, CASE WHEN starts THEN 'start' WHEN position >= 3 AND p >= 99.5e0 AND level >= 99.5e0 THEN 'held' ELSE 'free' END AS kind FROM stretches")
add_cte(
    "recent",
    "kinds",
    "SELECT *, CASE WHEN kind = 'free' THEN avg(greatest(0, level - p)) OVER (PARTITION BY site_id, stretch, kind ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS m FROM kinds",
)
add_cte(
    "acc",
    "recent active",
    "SELECT r.site_id, r.timestamp, n AS containers, n * sum(CASE kind WHEN 'start' THEN level WHEN 'free' THEN greatest(0, level - p) ELSE held END) OVER (PARTITION BY r.site_id, stretch ORDER BY timestamp) AS acc FROM"
    " (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY site_id, stretch ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM recent) r"
    " JOIN (SELECT site_id, count(*) AS n FROM active GROUP BY 1) c ON c.site_id = r.site_id",
)


def _clock(readings):
    """The time of the last reading."""
    return F.lit(readings.agg(F.max("reading_date").cast("string").alias("clock")).first().clock).cast("timestamp_ntz")


def _candidates(spark, sf):
    """The window ends with the last reading."""
    r = a.readings(spark, sf)
    return overload.candidates(a.sites(spark, sf), a.containers(spark, sf), r, _clock(r), OVERLOAD)


def accumulated(spark, sf):
    sites, hourly = _candidates(spark, sf)
    sites = cut(sites)
    return sites, overload.accumulated(hourly, sites.select("site_id", "containers"))


_CANDIDATE_IDS = "(SELECT s.id FROM live_sites s JOIN active c ON c.site_id = s.id GROUP BY s.id HAVING count(*) >= 2 OR s.id IN (SELECT c.site_id FROM readings r JOIN active c ON c.id = r.container_id WHERE r.reading_date >= (SELECT max(reading_date) FROM readings) - INTERVAL 28 DAY AND r.level >= 80))"


@query(
    "e06_accumulated_waste",
    with_ctes("acc live_sites", f"SELECT site_id, timestamp, {half_up('acc', 4)} AS acc FROM acc WHERE site_id IN {_CANDIDATE_IDS}"),
)
def _e06(spark, sf):
    return accumulated(spark, sf)[1].select("site_id", "timestamp", up(F.col("acc"), 4).alias("acc"))


@query(
    "d21_overload_hours",
    with_ctes(
        "acc live_sites",
        f"SELECT site_id, c AS containers, CAST(count(*) FILTER (acc >= 80 * c AND acc < 100 * c) AS DOUBLE) AS critical_hours, CAST(count(*) FILTER (acc >= 100 * c) AS DOUBLE) AS overflow_hours,"
        f" CAST(count(*) FILTER (acc >= 80 * c AND acc < 100 * c) + 3 * count(*) FILTER (acc >= 100 * c) AS DOUBLE) AS cost FROM acc, range(1, 9) r(c) WHERE site_id IN {_CANDIDATE_IDS} GROUP BY ALL",
    ),
)
def _d21(spark, sf):
    sites, acc = accumulated(spark, sf)
    wanted = sites.select("site_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(8).cast("bigint"))).alias("containers"))
    return overload.overload_hours(overload.overload_steps(acc), wanted)


@query(
    "i11_overload_candidates",
    with_ctes(
        "hourly live_sites",
        f"SELECT s.id AS site_id, n AS containers, coalesce(CAST(s.waste_type_id AS VARCHAR), '-') || '/' || t AS group_key, {half_up('h.m', 6)} AS average_level FROM live_sites s JOIN (SELECT site_id, count(*) AS n, min(container_type_id) AS t FROM active GROUP BY 1) c ON c.site_id = s.id"
        f" JOIN (SELECT site_id, avg(level) AS m FROM hourly GROUP BY 1) h ON h.site_id = s.id WHERE s.id IN {_CANDIDATE_IDS}",
    ),
)
def _i11(spark, sf):
    c, _ = _candidates(spark, sf)
    return c.select("site_id", "containers", "group_key", up(F.col("average_level"), 6).alias("average_level"))


def _limits(sites):
    return sites.withColumn("max_containers", (F.col("containers") + 1 + F.col("site_id") % 4).cast("int"))


def _curves(spark, sf):
    sites, acc = accumulated(spark, sf)
    acc = cut(acc)
    return _limits(sites), cut(overload.cost_curves(acc)), acc


def _overload_moves(spark, sites, curves):
    moves = overload.greedy_moves(sites, curves, OVERLOAD)
    if moves is not None:
        return moves
    return spark.createDataFrame(
        [], "group_key string, donor_id bigint, receiver_id bigint, distance_km double, overload_reduction double, round int"
    )


add_cte(
    "costs",
    "acc live_sites",
    f"SELECT site_id, any_value(containers) AS now, c, CAST(count(*) FILTER (acc >= 80 * c AND acc < 100 * c) + 3 * count(*) FILTER (acc >= 100 * c) AS DOUBLE) AS cost FROM acc, range(1, 9) r(c) WHERE site_id IN {_CANDIDATE_IDS} GROUP BY site_id, c",
)
add_cte(
    "curves",
    "costs live_sites active hourly",
    "SELECT *, 6371e0 * radians(longitude) * cos(radians(avg(latitude) OVER (PARTITION BY group_key))) AS x, 6371e0 * radians(latitude) AS y FROM (SELECT k.*, k.now + 1 + k.site_id % 4 AS cap, s.latitude, s.longitude, h.m AS average_level,"
    " coalesce(CAST(s.waste_type_id AS VARCHAR), '-') || '/' || t.t AS group_key FROM (SELECT site_id, any_value(now) AS now, list(cost ORDER BY c) AS costs FROM costs GROUP BY site_id) k JOIN live_sites s ON s.id = k.site_id"
    " JOIN (SELECT site_id, min(container_type_id) AS t FROM active GROUP BY 1) t ON t.site_id = k.site_id JOIN (SELECT site_id, avg(level) AS m FROM hourly GROUP BY 1) h ON h.site_id = k.site_id)",
)
add_cte(
    "near_sites",
    "curves",
    "SELECT d.group_key, d.site_id AS donor_id, r.site_id AS receiver_id, sqrt(pow(d.x - r.x, 2) + pow(d.y - r.y, 2)) AS distance_km, d.now AS dn, d.costs AS dc, r.now AS rn, r.costs AS rc, r.cap FROM curves d JOIN curves r"
    " ON d.group_key = r.group_key AND d.site_id <> r.site_id AND d.now >= 2 AND r.costs[r.now] > 0 AND sqrt(pow(d.x - r.x, 2) + pow(d.y - r.y, 2)) <= 2.5e0",
)
_COST = "CASE WHEN {n} BETWEEN 1 AND 8 THEN {c}[{n}] ELSE 0 END"
_DN, _RN = "(dn - g[donor_id + 1])", "(rn + t[receiver_id + 1])"
_GAIN = f"({_COST.format(n=_RN, c='rc')}) - ({_COST.format(n=f'{_RN} + 1', c='rc')}) - (({_COST.format(n=f'{_DN} - 1', c='dc')}) - ({_COST.format(n=_DN, c='dc')}))"
_SITES = "(SELECT list(0 ORDER BY i) FROM range((SELECT 1 + max(s_suppkey) FROM supplier)) r(i))"
# The sequential greedy: one best move a step; sites that gave no longer get, and the reverse.
_MOVES = with_ctes("near_sites hourly active", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + (
    ",\nwalk AS (SELECT 0 AS k, CAST(NULL AS STRUCT(loss DOUBLE, distance_km DOUBLE, donor_id BIGINT, receiver_id BIGINT, group_key VARCHAR)) AS e,"
    f" {_SITES} AS g, {_SITES} AS t UNION ALL SELECT k + 1, e, list_transform(g, lambda v, i: v + CASE WHEN i = e.donor_id + 1 THEN 1 ELSE 0 END), list_transform(t, lambda v, i: v + CASE WHEN i = e.receiver_id + 1 THEN 1 ELSE 0 END)"
    " FROM (SELECT any_value(k) AS k, any_value(g) AS g, any_value(t) AS t, min({'loss': -gain, 'distance_km': distance_km, 'donor_id': donor_id, 'receiver_id': receiver_id, 'group_key': group_key}) AS e"
    f" FROM (SELECT walk.k, walk.g, walk.t, n.*, {_GAIN} AS gain FROM walk, near_sites n WHERE t[donor_id + 1] = 0 AND {_DN} > 1 AND g[receiver_id + 1] = 0 AND {_RN} < cap) WHERE gain > 1e0 + 1e-9) WHERE e IS NOT NULL),"
    f"\nmoves AS (SELECT k, e.group_key, e.donor_id, e.receiver_id, e.distance_km AS raw_km, {half_even('e.distance_km', 4)} AS distance_km, {half_even('-e.loss', 4)} AS overload_reduction FROM walk WHERE k > 0)\n"
)


@query("i12_overload_greedy_plan", _MOVES + "SELECT group_key, donor_id, receiver_id, distance_km, overload_reduction FROM moves")
def _i12(spark, sf):
    sites, curves, _ = _curves(spark, sf)
    moves = _overload_moves(spark, sites, curves)
    return moves.select("group_key", "donor_id", "receiver_id", "distance_km", "overload_reduction")


def _fitted(raw: str, inner: str, outer: str) -> str:
    """Monotone least squares by the min-max formula, as a list for each site."""
    return (
        f"SELECT site_id, list(v ORDER BY k) AS f FROM (SELECT site_id, k, {outer}(m) AS v FROM (SELECT a.site_id, a.k, a.i, {inner}(b.m) AS m FROM (SELECT r.site_id, r.k, i.k AS i FROM {raw} r JOIN {raw} i ON i.site_id = r.site_id AND i.k <= r.k) a"
        f" JOIN (SELECT i.site_id, i.k AS i, j.k AS j, sum(v.v) / count(*) AS m FROM {raw} i JOIN {raw} j ON j.site_id = i.site_id AND j.k >= i.k JOIN {raw} v ON v.site_id = i.site_id AND v.k BETWEEN i.k AND j.k GROUP BY ALL) b"
        " ON b.site_id = a.site_id AND b.i = a.i AND b.j >= a.k GROUP BY ALL) GROUP BY ALL) GROUP BY site_id"
    )


add_cte(
    "raw_gains", "costs",
    "SELECT n.site_id, n.c - n.now + 1 AS k, n.cost - coalesce(x.cost, 0) AS v FROM costs n LEFT JOIN costs x ON x.site_id = n.site_id AND x.c = n.c + 1 WHERE n.c BETWEEN n.now AND n.now + n.site_id % 4",
)
add_cte("raw_damages", "costs", "SELECT n.site_id, n.now - n.c + 1 AS k, x.cost - n.cost AS v FROM costs n JOIN costs x ON x.site_id = n.site_id AND x.c = n.c - 1 WHERE n.c BETWEEN 2 AND n.now")


@query(
    "i13_marginal_curves",
    with_ctes(
        "raw_gains raw_damages costs",
        "SELECT s.site_id, s.now, list_filter(coalesce(g.f, CAST([] AS DOUBLE[])), lambda v: v > 1e0 + 1e-9) AS gains, coalesce(d.f, CAST([] AS DOUBLE[])) AS damages FROM (SELECT DISTINCT site_id, now FROM costs) s"
        f" LEFT JOIN ({_fitted('raw_gains', 'max', 'min')}) g ON g.site_id = s.site_id LEFT JOIN ({_fitted('raw_damages', 'min', 'max')}) d ON d.site_id = s.site_id",
    ),
)
def _i13(spark, sf):
    sites, curves, _ = _curves(spark, sf)
    return overload.marginal_curves(curves, sites, OVERLOAD.move_cost)


@query(
    "i14_useful_pairs",
    with_ctes(
        "costs live_sites active",
        "SELECT d.site_id AS donor_id, r.site_id AS receiver_id FROM (SELECT n.site_id, n.cost - x.cost AS damage FROM costs n JOIN costs x ON x.site_id = n.site_id AND n.c = n.now - 1 AND x.c = n.now WHERE n.now = 2"
        " UNION ALL SELECT a.site_id, least(a.cost - b.cost, (y.cost - b.cost) / 2) FROM costs b JOIN costs a ON a.site_id = b.site_id AND a.c = 2 JOIN costs y ON y.site_id = b.site_id AND y.c = 1 WHERE b.now = 3 AND b.c = 3) d,"
        " (SELECT site_id, max(g) AS gain FROM (SELECT n.site_id, (n.cost - x.cost) / (x.c - n.c) AS g FROM costs n JOIN costs x ON x.site_id = n.site_id AND n.c = n.now AND x.c > n.c AND x.c <= n.now + 1 + n.site_id % 4) GROUP BY 1) r"
        " WHERE d.site_id <> r.site_id AND d.damage + 1e0 < r.gain - 1e-9 AND EXISTS (SELECT 1 FROM live_sites a, live_sites b WHERE a.id = d.site_id AND b.id = r.site_id AND a.waste_type_id IS NOT DISTINCT FROM b.waste_type_id AND a.id % 4 = b.id % 4"
        " AND " + haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude") + " <= 2.5e0)",
    ),
)
def _i14(spark, sf):
    sites, curves, _ = _curves(spark, sf)
    marginal = overload.marginal_curves(curves, sites, OVERLOAD.move_cost)
    flags = sites.select("site_id", "group_key", "latitude", "longitude", F.lit(True).alias("can_donate"), F.lit(True).alias("can_receive"))
    pairs = spatial.planar_pairs(flags, OVERLOAD.max_distance_km)
    return overload.useful_pairs(pairs, marginal, OVERLOAD.move_cost).select("donor_id", "receiver_id")


def _fill(end: str, sign: str, steps: str) -> str:
    return half_even(f"least(100, {end}.average_level * {end}.now / ({end}.now {sign} {steps}))", 1)


@query(
    "i16_merged_moves",
    _MOVES
    + "SELECT p.group_key, p.donor_id, p.receiver_id, p.distance_km, p.overload_reduction, p.position, least_so_far AS merge_key, p.nd AS donor_rank, k.container_id,"
    f" {_fill('d', '-', '(nd - 1)')} AS donor_fill_before, {_fill('d', '-', 'nd')} AS donor_fill_after, {_fill('r', '+', '(nr - 1)')} AS receiver_fill_before, {_fill('r', '+', 'nr')} AS receiver_fill_after"
    " FROM (SELECT *, min(overload_reduction) OVER (PARTITION BY group_key ORDER BY k) AS least_so_far, row_number() OVER (PARTITION BY group_key ORDER BY k) AS position, row_number() OVER (PARTITION BY donor_id ORDER BY k) AS nd, row_number() OVER (PARTITION BY receiver_id ORDER BY k) AS nr FROM moves) p"
    " JOIN curves d ON d.site_id = p.donor_id JOIN curves r ON r.site_id = p.receiver_id JOIN (SELECT id AS container_id, site_id, row_number() OVER (PARTITION BY site_id ORDER BY current_level, id) AS n FROM active) k ON k.site_id = p.donor_id AND k.n = p.nd",
)
def _i16(spark, sf):
    sites, curves, _ = _curves(spark, sf)
    moves = _overload_moves(spark, sites, curves)
    ranks = arrivals.least_full_first(a.containers(spark, sf))
    placed = overload.assign_containers(overload.cumulative_levels(moves, sites, ["round"]), ranks)
    return overload.merge_groups(placed).select(
        "group_key", "donor_id", "receiver_id", "distance_km", "overload_reduction", "position", "merge_key", "donor_rank", "container_id",
        "donor_fill_before", "donor_fill_after", "receiver_fill_before", "receiver_fill_after",
    )


@query(
    "e15_cumulative_levels",
    with_ctes(
        "hourly active",
        f"SELECT d AS donor_id, r AS receiver_id, seq, {half_even('least(100, ad * nd / (nd + 10 - (kd - 1)))', 1)} AS donor_fill_before, {half_even('least(100, ar * nr / (nr + kr))', 1)} AS receiver_fill_after FROM (SELECT m.*, row_number() OVER (PARTITION BY d ORDER BY seq) AS kd, row_number() OVER (PARTITION BY r ORDER BY seq) AS kr, x.m AS ad, y.m AS ar, 3 AS nd, 3 AS nr"
        " FROM (SELECT site_id % 10 AS d, 10 + site_id % 7 AS r, site_id AS seq FROM (SELECT DISTINCT site_id FROM hourly)) m JOIN (SELECT site_id, avg(level) AS m FROM hourly GROUP BY 1) x ON x.site_id = d JOIN (SELECT site_id, avg(level) AS m FROM hourly GROUP BY 1) y ON y.site_id = r)",
    ).replace("least(100, ad * nd / (nd + 10 - (kd - 1)))", "least(100, ad * 13 / (13 - (kd - 1)))").replace("least(100, ar * nr / (nr + kr))", "least(100, ar * 13 / (13 + kr))"),
)
def _e15(spark, sf):
    r = a.readings(spark, sf)
    clock = _clock(r)
    h = history.hourly_levels(history.site_samples(r, a.containers(spark, sf), clock - F.expr("INTERVAL 28 DAYS"), clock))
    facts = h.groupBy("site_id").agg(F.avg("level").alias("average_level")).withColumn("containers", F.lit(13))
    moves = h.select("site_id").distinct().select((F.col("site_id") % 10).alias("donor_id"), (F.col("site_id") % 7 + 10).alias("receiver_id"), F.col("site_id").alias("seq"))
    return overload.cumulative_levels(moves, facts, ["seq"]).select("donor_id", "receiver_id", "seq", "donor_fill_before", "receiver_fill_after")


_OVER = _MOVES + (
    ", changed AS (SELECT c.*, now - coalesce(g.n, 0) + coalesce(t.n, 0) AS fin FROM curves c LEFT JOIN (SELECT donor_id, count(*) AS n FROM moves GROUP BY 1) g ON g.donor_id = c.site_id LEFT JOIN (SELECT receiver_id, count(*) AS n FROM moves GROUP BY 1) t ON t.receiver_id = c.site_id),"
    "\nhours AS (SELECT site_id, c, CAST(count(*) FILTER (acc >= 80 * c AND acc < 100 * c) AS DOUBLE) AS cr, CAST(count(*) FILTER (acc >= 100 * c) AS DOUBLE) AS ov FROM acc, range(1, 16) r(c) GROUP BY ALL),"
    "\nsums AS (SELECT sum(b.cr) AS cb, sum(b.ov) AS ob, sum(a.cr) AS ca, sum(a.ov) AS oa FROM changed s JOIN hours b ON b.site_id = s.site_id AND b.c = s.now JOIN hours a ON a.site_id = s.site_id AND a.c = s.fin),"
    f"\nfilled AS (SELECT now, fin, {half_even('least(100, average_level * now / now)', 1)} AS lb, {half_even('least(100, average_level * now / fin)', 1)} AS la FROM changed)"
    f"\nSELECT m.total AS total_containers_moved, m.receivers AS sites_receiving, m.donors AS sites_donating, m.km AS avg_distance_km, 0 AS sites_emptied, o.m AS original_mean_fill, o.s AS original_std_fill, n.m AS optimized_mean_fill, n.s AS optimized_std_fill,"
    f" CASE WHEN cb + 3 * ob > 0 THEN {half_even('(cb + 3 * ob - ca - 3 * oa) / (cb + 3 * ob)', 4)} ELSE 0e0 END AS expected_improvement, {half_even('cb', 1)} AS critical_hours_before, {half_even('ca', 1)} AS critical_hours_after, {half_even('ob', 1)} AS overflow_hours_before, {half_even('oa', 1)} AS overflow_hours_after"
    f" FROM sums, (SELECT count(*) AS total, count(DISTINCT receiver_id) AS receivers, count(DISTINCT donor_id) AS donors, coalesce({half_even('avg(distance_km)', 4)}, 0e0) AS km FROM moves) m, (SELECT {_spread('lb', 'now')} FROM filled) o, (SELECT {_spread('la', 'fin')} FROM filled) n"
)


@query("d31_overload_summary", _OVER)
def _d31o(spark, sf):
    sites, curves, acc = _curves(spark, sf)
    moves = _overload_moves(spark, sites, curves)
    return overload.plan_summary(moves, sites, overload.overload_steps(acc))
