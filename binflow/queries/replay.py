"""Checks of the what-if network and its replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow import adapter as a
from binflow.functions import times
from binflow.functions.numbers import half_even as even
from binflow.functions.numbers import half_up as up
from binflow.operators import network, readings as arrivals
from binflow.plans import whatif
from binflow.plans.scan import prefixes, time_block
from binflow.queries.duck import add_cte, half_even, half_up, with_ctes
from binflow.queries.registry import query
from binflow.session import cut


def _moves(spark, sf):
    c = a.containers(spark, sf).where("deleted_at IS NULL AND NOT available")
    return c.select(F.col("id").alias("container_id"), ((F.col("site_id") * 7 + 3) % 10).alias("to_site_id"))


add_cte("moves", "active", "SELECT id AS container_id, (site_id * 7 + 3) % 10 AS to_site_id FROM active WHERE NOT available")
add_cte(
    "virtual",
    "active moves",
    "SELECT c.id AS container_id, c.site_id AS original_site_id, coalesce(m.to_site_id, c.site_id) AS optimized_site_id, CASE WHEN m.to_site_id IS NOT NULL THEN 0e0 ELSE CAST(c.current_level AS DOUBLE) END AS level, c.last_reading"
    " FROM active c LEFT JOIN moves m ON m.container_id = c.id",
)
add_cte("overlay", "active virtual", "SELECT c.id, v.optimized_site_id AS site_id, v.level FROM active c JOIN virtual v ON v.container_id = c.id")
add_cte(
    "plan_levels",
    "live_sites overlay",
    "SELECT s.id AS site_id, coalesce(avg(c.level), 0e0) AS avg_level, count(c.id) AS container_count FROM live_sites s LEFT JOIN overlay c ON c.site_id = s.id GROUP BY s.id",
)


@query("i17_activation_snapshot", with_ctes("virtual", "SELECT container_id, original_site_id, optimized_site_id, level, last_reading, last_reading AS virtual_updated_at FROM virtual"))
def _i17(spark, sf):
    s = whatif.activate(a.containers(spark, sf), _moves(spark, sf))
    return s.select("container_id", "original_site_id", "optimized_site_id", "level", "last_reading", "virtual_updated_at")


def _state(spark, sf):
    return whatif.activate(a.containers(spark, sf), _moves(spark, sf))


@query("c04_whatif_overlay", with_ctes("overlay", "SELECT id, site_id, level FROM overlay"))
def _c04(spark, sf):
    return whatif.overlay(a.containers(spark, sf), _state(spark, sf))


def _stats(name: str) -> str:
    return (
        f"(SELECT {half_even('avg(avg_level)', 2)} AS m, {half_even('sqrt(greatest(0, avg(avg_level * avg_level) - avg(avg_level) * avg(avg_level)))', 2)} AS s, count(*) FILTER (avg_level >= 80) AS c FROM {name})"
    )


@query(
    "d02_kpi_comparison",
    with_ctes(
        "site_levels plan_levels",
        f"SELECT r.m AS real_mean_fill_level, p.m AS plan_mean_fill_level, r.s AS real_std_fill_level, p.s AS plan_std_fill_level, CASE WHEN r.s > 0 THEN {half_even('(r.s - p.s) / r.s * 100', 2)} ELSE 0e0 END AS std_reduction_pct,"
        f" greatest(0, r.c - p.c) AS critical_sites_reduction, r.s - p.s > 0.05e0 AS is_improved FROM {_stats('site_levels')} r, {_stats('plan_levels')} p",
    ),
)
def _d02(spark, sf):
    k = whatif.kpi_comparison(a.sites(spark, sf), a.containers(spark, sf), _state(spark, sf))
    return k.select(
        "real_mean_fill_level", "plan_mean_fill_level", "real_std_fill_level", "plan_std_fill_level", "std_reduction_pct", "critical_sites_reduction", "is_improved"
    )


_SERIES = "(SELECT *, lag(level) OVER w AS before, (epoch_us(reading_date) - epoch_us(lag(reading_date) OVER w)) / 3600000000e0 AS elapsed FROM readings WINDOW w AS (PARTITION BY container_id ORDER BY reading_date, id))"


def _with_before(spark, sf):
    r = a.readings(spark, sf)
    week = time_block("at", 168)
    rows = r.withColumn("at", times.epoch_micros(F.col("reading_date")))
    rows = arrivals.with_previous(rows, "container_id", ["reading_date", "id"], week, {"level": "before", "reading_date": "before_at"})
    return rows.withColumn("before", F.col("before").cast("double")).withColumn("elapsed", times.hours_between(F.col("before_at"), F.col("reading_date")))


@query(
    "e13_overflow_hours",
    with_ctes(
        "readings",
        f"SELECT id, {half_up('CASE WHEN coalesce(elapsed, 0) <= 0 OR a < 100 THEN 0e0 WHEN before >= 100 THEN elapsed ELSE elapsed * (a - 100) / (a - before) END', 6)} AS full_hours FROM (SELECT *, level * 1.3e0 AS a FROM {_SERIES}) WHERE before IS NOT NULL",
    ),
)
def _e13(spark, sf):
    r = _with_before(spark, sf)
    share = whatif.overflow_share(F.col("before"), F.col("level") * 1.3, F.col("elapsed"))
    return r.where(F.col("before").isNotNull()).select("id", up(share, 6).alias("full_hours"))


def _rates(spark, sf):
    r = _with_before(spark, sf)
    valid = (~F.col("collected")) & F.col("before").isNotNull() & (F.col("level") < 99.5) & (F.col("elapsed") > 0)
    rate = F.when(valid, F.greatest(F.col("level") - F.col("before"), F.lit(0.0)) / F.col("elapsed"))
    return r.select("container_id", times.epoch_micros(F.col("reading_date")).alias("at"), "id", rate.alias("rate"))


@query(
    "e12_fill_rate_ewma",
    with_ctes(
        "readings",
        f"SELECT container_id, {half_up('list_reduce(list(rate ORDER BY reading_date, id), lambda acc, x: 0.3e0 * x + 0.7e0 * acc)', 6)} AS rate_ewma FROM (SELECT *, greatest(level - before, 0) / elapsed AS rate FROM {_SERIES} WHERE NOT collected AND before IS NOT NULL AND level < 99.5e0 AND elapsed > 0) GROUP BY container_id",
    ),
)
def _e12(spark, sf):
    rows = _rates(spark, sf).withColumn("block", time_block("at", 96))
    out = prefixes(rows, "container_id", ("at", "id"), "block", whatif.RATES, whatif.rate_function(F.col("rate")))
    last = out.groupBy("container_id").agg(F.max_by("until", F.struct("at", "id")).alias("until"))
    rate = whatif.RATES.after("until", F.lit(None).cast("double"))
    return last.select("container_id", rate.alias("r")).where(F.col("r").isNotNull()).select("container_id", up(F.col("r"), 6).alias("rate_ewma"))


def accepted(spark, sf):
    r = arrivals.accepted_readings(a.readings(spark, sf)).where("accepted")
    return r.select(
        "container_id", F.col("id").alias("seq"), F.col("level_old").alias("level_before"), F.col("level").alias("level_after"), "reading_date", "collected"
    )


add_cte(
    "accepted",
    "readings",
    "SELECT container_id, id AS seq, CAST(b.l AS DOUBLE) AS before, CAST(level AS DOUBLE) AS after, reading_date, collected FROM (SELECT *, max({'d': reading_date, 's': -id, 'l': level}) OVER (PARTITION BY container_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM readings) WHERE b IS NULL OR reading_date > b.d",
)
# After a reset every level is 0; a container that joins has no level before its first reading.
add_cte(
    "start",
    "virtual accepted containers",
    "SELECT container_id, original_site_id AS o, optimized_site_id AS p FROM virtual UNION ALL SELECT id, site_id, site_id FROM containers WHERE site_id IS NOT NULL AND id IN (SELECT container_id FROM accepted) AND id NOT IN (SELECT container_id FROM virtual)",
)
add_cte(
    "paced",
    "accepted start",
    "SELECT *, CASE WHEN NOT collected AND before IS NOT NULL AND after < 99.5e0 AND elapsed > 0 THEN greatest(after - before, 0) / elapsed END AS rate FROM (SELECT a.*, greatest(0, coalesce((epoch_us(reading_date) - epoch_us(lag(reading_date) OVER (PARTITION BY container_id ORDER BY reading_date, seq))) / 3600000000e0, 0)) AS elapsed FROM accepted a SEMI JOIN start USING (container_id))",
)
_SMOOTHED = "list_reduce(list(rate) FILTER (rate IS NOT NULL) OVER (PARTITION BY container_id ORDER BY reading_date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND {0}), lambda acc, x: 0.3e0 * x + 0.7e0 * acc)"


def _full_hours(before: str, after: str) -> str:
    return f"CASE WHEN elapsed <= 0 OR {after} < 100 THEN 0e0 WHEN {before} >= 100 THEN elapsed ELSE elapsed * ({after} - 100) / ({after} - {before}) END"


add_cte(
    "arrived",
    "paced",
    f"SELECT *, CASE WHEN before IS NOT NULL AND NOT collected THEN {_full_hours('before', '(before + made)')} WHEN before >= 99.5e0 THEN elapsed ELSE 0e0 END AS real_full FROM ("
    "SELECT *, CASE WHEN before IS NULL THEN 0e0 WHEN after >= 99.5e0 AND rate_before IS NOT NULL THEN greatest(after - before, rate_before * elapsed) ELSE after - before END AS made FROM ("
    f"SELECT *, {_SMOOTHED.format('1 PRECEDING')} AS rate_before, {_SMOOTHED.format('CURRENT ROW')} AS rate_after FROM paced))",
)
add_cte("stayers", "start", "SELECT p AS site, count(*) FILTER (o IS NOT DISTINCT FROM p) AS k, count(*) FILTER (o IS DISTINCT FROM p) AS a FROM start GROUP BY p")
add_cte(
    "shared",
    "arrived start stayers",
    "SELECT r.*, s.o, s.o IS NOT DISTINCT FROM s.p AS stays, coalesce(n.k, 0) AS k, coalesce(n.a, 0) AS a FROM arrived r JOIN start s USING (container_id) LEFT JOIN stayers n ON n.site = s.o",
)
add_cte(
    "happened",
    "shared start",
    "SELECT container_id, reading_date, seq, collected AS is_set, CASE WHEN collected THEN after ELSE made * k / (k + a) END AS amount FROM shared WHERE stays"
    " UNION ALL SELECT s.container_id, reading_date, seq, collected, CASE WHEN collected THEN 0e0 ELSE made / (k + a) END FROM shared r JOIN start s ON s.p = r.o AND s.o IS DISTINCT FROM s.p WHERE stays"
    " UNION ALL SELECT s.container_id, reading_date, seq, false, made / k FROM shared r JOIN start s ON s.p = r.o AND s.o IS NOT DISTINCT FROM s.p WHERE NOT stays AND NOT collected AND k > 0",
)
# The level before an event: all earlier ones, one after the other.
add_cte(
    "changed_levels",
    "happened",
    f"SELECT container_id, reading_date, seq, CASE WHEN is_set THEN least(100, greatest(0, amount)) ELSE least(100, greatest(0, level + amount)) END AS new_level, CASE WHEN is_set THEN CASE WHEN level >= 100 THEN elapsed ELSE 0e0 END ELSE {_full_hours('level', '(level + amount)')} END AS full_hours FROM ("
    "SELECT *, list_reduce(list_prepend({'l': 0e0, 's': false, 'a': 0e0}, coalesce(earlier, [])), lambda q, x: {'l': CASE WHEN x.s THEN least(100, greatest(0, x.a)) ELSE least(100, greatest(0, q.l + x.a)) END, 's': x.s, 'a': x.a}).l AS level FROM ("
    "SELECT *, list({'l': 0e0, 's': is_set, 'a': amount}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier, greatest(0, coalesce((epoch_us(reading_date) - epoch_us(lag(reading_date) OVER w)) / 3600000000e0, 0)) AS elapsed FROM happened WINDOW w AS (PARTITION BY container_id ORDER BY reading_date, seq)))",
)


@query(
    "s07_whatif_replay",
    with_ctes(
        "changed_levels arrived start",
        f"SELECT s.container_id, o AS original_site_id, p AS optimized_site_id, {half_up('coalesce(l.level, 0)', 6)} AS level, r.newest AS last_reading, l.newest AS virtual_updated_at, {half_up('r.rate', 6)} AS rate_ewma, {half_up('coalesce(l.hours, 0)', 6)} AS overflow_hours, {half_up('coalesce(r.hours, 0)', 6)} AS real_overflow_hours FROM start s"
        " LEFT JOIN (SELECT container_id, arg_max(new_level, (reading_date, seq)) AS level, max(reading_date) AS newest, sum(full_hours) AS hours FROM changed_levels GROUP BY 1) l USING (container_id)"
        " LEFT JOIN (SELECT container_id, arg_max(rate_after, (reading_date, seq)) AS rate, max(reading_date) AS newest, sum(real_full) AS hours FROM arrived GROUP BY 1) r USING (container_id)",
    ),
)
def _s07(spark, sf):
    state = whatif.reset(_state(spark, sf))
    # Read for the newcomers, the blocks and the series; accepted once.
    after = whatif.replay(state, cut(accepted(spark, sf)), a.containers(spark, sf))
    return after.withColumns({c: up(F.col(c), 6) for c in ("level", "rate_ewma", "overflow_hours", "real_overflow_hours")})


def _snapshots(spark, sf):
    e = a.table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 10).alias("plan_id"), F.col("ts").alias("observed_at"),
        (F.col("event_id") % 7).alias("real_critical_sites"), (F.col("event_id") % 5).alias("critical_sites"),
        (F.col("event_id") % 11).alias("real_full_containers"), (F.col("event_id") % 3).alias("full_containers"),
    )


@query(
    "e11_time_integrated_counters",
    "WITH s AS (SELECT user_id % 10 AS plan_id, ts, event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts)) - epoch_us(ts)) / 3600000000e0 AS h FROM events)"
    f" SELECT plan_id, {half_up('sum(h)', 4)} AS observed_hours, {half_up('sum(h * (event_id % 7))', 4)} AS real_critical_sites_hours, {half_up('sum(h * (event_id % 3))', 4)} AS full_containers_hours FROM s GROUP BY plan_id",
)
def _e11(spark, sf):
    t = whatif.tracked_totals(_snapshots(spark, sf))
    return t.select("plan_id", *[up(F.col(c), 4).alias(c) for c in ("observed_hours", "real_critical_sites_hours", "full_containers_hours")])


@query(
    "e11_thinned_counts",
    "WITH RECURSIVE s AS (SELECT user_id % 10 AS plan_id, ts FROM events), k AS (SELECT plan_id, min(ts) AS ts FROM s GROUP BY 1 UNION ALL SELECT k.plan_id, (SELECT min(s.ts) FROM s WHERE s.plan_id = k.plan_id AND s.ts >= k.ts + INTERVAL 120 MINUTE) AS ts FROM k WHERE k.ts IS NOT NULL)"
    " SELECT plan_id, ts AS observed_at FROM k WHERE ts IS NOT NULL",
)
def _e11t(spark, sf):
    return whatif.thin_counts(_snapshots(spark, sf), 120).select("plan_id", "observed_at")


@query(
    "i18_whatif_comparison",
    with_ctes(
        "site_levels plan_levels overlay",
        f"SELECT t.plan_id, {half_even('o', 2)} AS observed_hours, {half_even('rc / o', 1)} AS avg_real_critical_sites, {half_even('cs / o', 1)} AS avg_critical_sites, (SELECT count(*) FROM site_levels WHERE avg_level >= 80) AS real_critical_sites_now,"
        " (SELECT count(*) FROM plan_levels WHERE avg_level >= 80) AS critical_sites_now, (SELECT count(*) FROM active WHERE current_level >= 100) AS real_full_containers_now, (SELECT count(*) FROM overlay WHERE level >= 100) AS full_containers_now FROM ("
        "SELECT plan_id, sum(h) AS o, sum(h * (event_id % 7)) AS rc, sum(h * (event_id % 5)) AS cs FROM (SELECT user_id % 10 AS plan_id, event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts)) - epoch_us(ts)) / 3600000000e0 AS h FROM events) GROUP BY plan_id) t",
    ),
)
def _i18(spark, sf):
    state = _state(spark, sf)
    counts = whatif.network_counts(a.sites(spark, sf), a.containers(spark, sf), state)
    c = whatif.comparison(whatif.tracked_totals(_snapshots(spark, sf)), state, counts)
    return c.select(
        "plan_id", "observed_hours", "avg_real_critical_sites", "avg_critical_sites", "real_critical_sites_now", "critical_sites_now", "real_full_containers_now", "full_containers_now"
    )
