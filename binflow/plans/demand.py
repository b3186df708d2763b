"""Waste demand: census allocation, land use, zone profiles and their hourly curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binflow.functions import text, times
from binflow.functions.numbers import half_even
from binflow.operators.filters import parcel_category, zone_type
from binflow.session import attach, small

# Kilos per person and day, kilos per cubic metre, lowest daily fill in
# percent, daily kilos of a container outside every tract.
KG_PER_PERSON, KG_PER_M3, MIN_DAILY_FILL, FALLBACK_KG = 1.5, 150.0, 20.0, 150.0

USES = ("residential_multifamily", "residential_singlefamily", "commercial", "office", "industrial")
PERCENT_COLUMNS = dict(zip(USES, ("res_multifamily_pct", "res_singlefamily_pct", "commercial_pct", "office_pct", "industrial_pct")))
# Demand and weekend weights of each land use; percentages of a tract
# without parcels.
DEMAND_WEIGHTS = {"residential_multifamily": 1.10, "residential_singlefamily": 0.95, "commercial": 1.40, "office": 0.85, "industrial": 0.65, "other": 0.50}
WEEKEND_WEIGHTS = {"residential_multifamily": 0.60, "residential_singlefamily": 0.85, "commercial": 1.20, "office": 0.10, "industrial": 0.20, "other": 0.75}
DEFAULT_MIX = (40.0, 40.0, 10.0, 5.0, 5.0)
# Hour weights and weekday factors of each zone type (Monday = 0).
HOUR_WEIGHTS = {
    "residential_multifamily": {3: 0.25, 7: 1.3, 8: 1.6, 9: 1.4, 14: 0.5, 19: 1.2, 20: 1.5, 21: 1.7, 22: 1.4},
    "residential_singlefamily": {3: 0.25, 8: 1.1, 12: 1.2, 13: 1.2, 19: 1.3, 20: 1.5, 21: 1.6, 22: 1.3},
    "residential": {3: 0.25, 7: 1.3, 8: 1.5, 9: 1.3, 14: 0.5, 20: 1.4, 21: 1.6, 22: 1.4},
    "commercial": {3: 0.25, 11: 1.3, 12: 1.6, 13: 1.8, 14: 1.5, 19: 1.4, 20: 1.6, 21: 1.5},
    "office": {3: 0.25, 8: 1.2, 9: 1.3, 12: 1.5, 13: 1.7, 14: 1.4, 17: 1.2, 18: 1.0},
    "industrial": {3: 0.25, 7: 1.2, 8: 1.4, 12: 1.3, 17: 1.3},
    "mixed": {3: 0.25, 8: 1.2, 12: 1.4, 13: 1.5, 20: 1.3, 21: 1.4},
}
WEEKDAY_FACTORS = {
    "residential_multifamily": {0: 0.85, 5: 0.60, 6: 0.55},
    "residential_singlefamily": {0: 0.95, 5: 0.88, 6: 0.85},
    "residential": {0: 0.80, 5: 0.65, 6: 0.60},
    "commercial": {5: 1.20, 6: 1.10},
    "office": {0: 0.95, 5: 0.12, 6: 0.08},
    "industrial": {5: 0.20, 6: 0.08},
    "mixed": {5: 0.90, 6: 0.80},
}
BASE_MULTIPLIERS = {"residential_multifamily": 1.10, "residential_singlefamily": 0.95, "residential": 1.00, "commercial": 1.40, "office": 0.85, "industrial": 0.65, "mixed": 1.00}
# Target of the mean zone multiplier and its tolerance in percent.
CALIBRATION_TARGET, CALIBRATION_TOLERANCE = 1.05, 3.0


def allocate(links: DataFrame, tracts: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Kilos each tract sends to each linked container, by weight (evenly when all weights
    are zero). Sums join back, so a tract with very many links is no window partition."""
    sums = links.groupBy("radio_code").agg(F.sum("weight").alias("pool"), F.count("*").alias("linked"))
    rows = links.join(sums, "radio_code").join(tracts.select("radio_code", "population", "department_name"), "radio_code")
    share = F.when(F.col("pool") > 0, F.col("weight") / F.col("pool")).otherwise(1.0 / F.col("linked"))
    return rows.withColumn("kg", F.col("population") * KG_PER_PERSON * multiplier * share)


def container_demand(allocated: DataFrame, containers: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Daily kilos, dominant tract and fill rates of every container (id, volume_m3)."""
    per = allocated.groupBy("container_id").agg(
        F.sum("kg").alias("daily"),
        F.max_by(F.struct("radio_code", "population", "department_name", "linked"), F.struct("kg", "radio_code")).alias("top"),
        F.array_sort(F.collect_set("radio_code")).alias("radio_codes"),
    )
    rows = containers.select(F.col("id").alias("container_id"), F.coalesce("volume_m3", F.lit(1.0)).alias("volume_m3")).join(per, "container_id", "left")
    daily = F.coalesce("daily", F.lit(FALLBACK_KG * multiplier))
    fill = F.greatest(F.lit(MIN_DAILY_FILL), daily / (F.col("volume_m3") * KG_PER_M3) * 100.0)
    return rows.select(
        "container_id",
        F.coalesce("top.radio_code", F.lit("UNKNOWN")).alias("radio_code"),
        F.coalesce("top.department_name", F.lit("UNKNOWN")).alias("department_name"),
        F.coalesce("radio_codes", F.array().cast("array<string>")).alias("radio_codes"),
        F.coalesce("top.population", F.lit(0)).cast("bigint").alias("population"),
        F.coalesce("top.linked", F.lit(1)).cast("bigint").alias("containers_in_radio"),
        half_even(daily, 4).alias("daily_waste_kg"),
        half_even(F.col("volume_m3") * KG_PER_M3, 2).alias("capacity_kg"),
        half_even(fill, 4).alias("daily_fill_pct"),
        half_even(fill / 24.0, 4).alias("hourly_fill_pct"),
    )


def tract_summary(links: DataFrame, tracts: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Containers per tract and the mean kilos each gets."""
    n = links.groupBy("radio_code").agg(F.count("*").alias("total_containers"))
    return n.join(tracts, "radio_code").select(
        "radio_code", "department_name", "population", "total_containers",
        half_even(F.col("population") * KG_PER_PERSON / F.col("total_containers") * multiplier, 4).alias("daily_waste_per_container_kg"),
    )


# Edges of the hourly fill histogram.
HISTOGRAM_EDGES = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0)


def histogram(demand: DataFrame, column: str = "hourly_fill_pct", edges: tuple[float, ...] = HISTOGRAM_EDGES) -> DataFrame:
    """(bin, count) with half-open bins; the last one is open-ended."""
    v = F.col(column)
    index = F.lit(None).cast("int")
    for i, low in enumerate(edges):
        index = F.when(v >= low, F.lit(i)).otherwise(index)
    counted = demand.select(index.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("count"))
    every = demand.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def order_statistics(df: DataFrame, column: str, fractions: dict[str, float], width: float = 0.25) -> DataFrame:
    """One row with the sorted values at index int(n * p), exact and without a global sort.

    Counts per bin of `width` locate the bin holding each index; only the distinct values
    of those bins are then ranked, each bin on its own.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    values = values.withColumn("bin", F.floor(F.col("v") / width))
    bins = values.groupBy("bin").agg(F.sum("n").alias("in_bin")).withColumn("run", F.floor(F.col("bin") / 4096))
    # Bins cumulate within runs of 4096, runs among themselves: a run is one row there.
    runs = bins.groupBy("run").agg(F.sum("in_bin").alias("in_run"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("in_run").over(earlier), F.lit(0)).alias("start"))
    order = Window.partitionBy("run").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = attach(bins.join(runs, "run"), bins.agg(F.sum("in_bin").alias("total"))).withColumn("before", F.col("start") + F.coalesce(F.sum("in_bin").over(order), F.lit(0))).drop("run", "start")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in fractions.items()]))
    hit = placed.select("*", asked.alias("q")).withColumn("index", F.least(F.floor(F.col("total") * F.col("q.p")), F.col("total") - 1))
    hit = hit.where((F.col("index") >= F.col("before")) & (F.col("index") < F.col("before") + F.col("in_bin"))).select("q.name", "bin", "index", "before")
    running = F.sum("n").over(Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.join(F.broadcast(hit.select("bin").distinct()), "bin", "left_semi").withColumn("upto", running)
    found = ranked.join(F.broadcast(hit), "bin").where(F.col("before") + F.col("upto") > F.col("index")).groupBy("name").agg(F.min("v").alias("v"))
    return found.agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in fractions])


def distribution_stats(demand: DataFrame, column: str = "hourly_fill_pct") -> DataFrame:
    basic = demand.agg(F.count(column).alias("n"), F.coalesce(F.avg(column), F.lit(0.0)).alias("mean"), F.coalesce(F.max(column), F.lit(0.0)).alias("max"))
    return attach(basic, order_statistics(demand, column, {"p50": 0.5, "p90": 0.9, "p99": 0.99}))


def tract_rates(links: DataFrame, demand: DataFrame, tracts: DataFrame) -> DataFrame:
    """Tracts with their linked containers and mean hourly fill."""
    rates = links.join(demand.select("container_id", "hourly_fill_pct"), "container_id")
    per = rates.groupBy("radio_code").agg(F.count("*").alias("container_count"), half_even(F.avg("hourly_fill_pct"), 3).alias("avg_hourly_pct"))
    return per.join(tracts.select("radio_code", "department_name", "population"), "radio_code")


def district_rollup(demand: DataFrame, tracts: DataFrame) -> DataFrame:
    """Districts with containers of their own tracts: counts, mean hourly fill, people."""
    held = demand.groupBy("department_name").agg(F.count("*").alias("container_count"), half_even(F.avg("hourly_fill_pct"), 3).alias("avg_hourly"))
    people = tracts.groupBy("department_name").agg(F.count("*").alias("radio_count"), F.sum("population").alias("population_total"))
    return held.join(people, "department_name")


def hotspots(rates: DataFrame, count: int = 5) -> DataFrame:
    """Tracts with the highest and the lowest mean fill."""
    high = rates.orderBy(F.col("avg_hourly_pct").desc(), "radio_code").limit(count).withColumn("side", F.lit("high"))
    low = rates.orderBy("avg_hourly_pct", F.col("radio_code").desc()).limit(count).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def low_coverage(rates: DataFrame, at_most: int = 3) -> DataFrame:
    return rates.where(F.col("container_count") <= at_most)


def demand_multiplier(shares: list[Column]) -> Column:
    """Weighted demand of the five land-use percentages; the rest counts as other."""
    rest = F.greatest(F.lit(0.0), 100.0 - sum(shares[1:], shares[0]))
    terms = [s / 100.0 * DEMAND_WEIGHTS[u] for s, u in zip([*shares, rest], [*USES, "other"])]
    return half_even(sum(terms[1:], terms[0]), 4)


def weekend_factor(shares: list[Column]) -> Column:
    total = sum(shares[1:], shares[0])
    terms = [s / total * WEEKEND_WEIGHTS[u] for s, u in zip(shares, USES)]
    return F.when(total > 0, half_even(sum(terms[1:], terms[0]), 4)).otherwise(F.lit(WEEKEND_WEIGHTS["other"]))


def land_use(parcels: DataFrame, key: str, everyone: DataFrame | None = None) -> DataFrame:
    """Percentages per land use, zone type, demand and weekend factors per key. Keys of
    `everyone` without parcels get the default mix."""
    category = parcel_category(F.col("tipo1"), F.col("tipo2"), F.col("pisos"))
    counted = parcels.select(key, category.alias("category")).groupBy(key).agg(
        F.count("*").alias("total_parcelas"), *[F.count_if(F.col("category") == u).alias(u) for u in USES]
    )
    rows = counted if everyone is None else everyone.select(key).join(counted, key, "left")
    total = F.coalesce("total_parcelas", F.lit(0))
    shares = [
        F.when(total > 0, half_even(F.col(u) / F.col("total_parcelas") * 100.0, 2)).otherwise(F.lit(d)).alias(PERCENT_COLUMNS[u])
        for u, d in zip(USES, DEFAULT_MIX)
    ]
    out = rows.select(key, total.cast("bigint").alias("total_parcelas"), *shares)
    s = [F.col(c) for c in PERCENT_COLUMNS.values()]
    return out.withColumn("zone_type", zone_type(*s)).withColumn("demand_multiplier", demand_multiplier(s)).withColumn("weekend_factor", weekend_factor(s))


def zone_counts(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("zone_type").agg(F.count("*").alias("radios"))


def calibration(profiles: DataFrame, target: float = CALIBRATION_TARGET, tolerance: float = CALIBRATION_TOLERANCE) -> DataFrame:
    """One row: factor that brings the mean demand multiplier to the target when it is
    outside the tolerance."""
    mean = F.avg("demand_multiplier")
    low, high = target * (1 - tolerance / 100), target * (1 + tolerance / 100)
    keep = mean.isNull() | (mean <= 0) | mean.between(low, high)
    return profiles.agg(F.when(keep, F.lit(1.0)).otherwise(F.lit(target) / mean).alias("calibration"))


def type_curves(spark: SparkSession) -> DataFrame:
    """Hour weights and weekday factors of the zone types as rows of maps."""

    def literal(mapping: dict[int, float]) -> str:
        return "map(" + ", ".join(f"{k}, {v}D" for k, v in mapping.items()) + ")"

    rows = ", ".join(f"('{z}', {literal(HOUR_WEIGHTS[z])}, {literal(WEEKDAY_FACTORS[z])})" for z in HOUR_WEIGHTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(zone_type, hour_weights, weekday_factors)")


def fill_hours(curves: DataFrame, key: str) -> DataFrame:
    """(key, hour, weight) for 24 hours: defined hours kept, the rest interpolated on the
    circle; one everywhere when none is defined."""
    known = F.array_sort(F.map_keys("hour_weights"))
    rows = curves.select(key, "hour_weights", known.alias("known"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    h = F.col("hour")
    earlier, later = F.filter("known", lambda k: k < h), F.filter("known", lambda k: k > h)
    low = F.when(F.size(earlier) > 0, F.array_max(earlier)).otherwise(F.array_max("known") - 24)
    high = F.when(F.size(later) > 0, F.array_min(later)).otherwise(F.array_min("known") + 24)
    rows = rows.withColumn("low", low).withColumn("high", high)

    def at(k: str) -> Column:
        return F.col("hour_weights")[F.pmod(F.col(k), F.lit(24))]

    between = at("low") + (at("high") - at("low")) * ((h - F.col("low")) / (F.col("high") - F.col("low")))
    weight = F.when(F.size("known") == 0, F.lit(1.0)).otherwise(F.coalesce(F.col("hour_weights")[h], between))
    return rows.select(key, "hour", weight.alias("weight"))


def weekly_curves(curves: DataFrame, key: str) -> DataFrame:
    """(key, weekday, hour, value) with mean one over the 168 cells of the week."""
    hours = fill_hours(curves, key)
    days = curves.select(key, "weekday_factors", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    cells = hours.join(days, key).withColumn("raw", F.col("weight") * F.coalesce(F.col("weekday_factors")[F.col("weekday")], F.lit(1.0)))
    mean = F.avg("raw").over(Window.partitionBy(key))
    return cells.withColumn("mean", mean).select(
        key, "weekday", "hour", (F.col("raw") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(F.lit(1.0))).alias("value")
    )


def mixed_curves(profiles: DataFrame, curves: DataFrame, key: str) -> DataFrame:
    """Weekly curve of each profile: its land uses' curves weighted by share times waste."""
    weighted = F.explode(
        F.array(*[F.struct(F.lit(u).alias("zone_type"), (F.coalesce(F.col(c), F.lit(0.0)) * DEMAND_WEIGHTS[u]).alias("w")) for u, c in PERCENT_COLUMNS.items()])
    )
    parts = profiles.select(key, weighted.alias("p")).select(key, "p.zone_type", "p.w")
    totals = parts.groupBy(key).agg(F.sum("w").alias("total")).where(F.col("total") > 0)
    shares = parts.where(F.col("w") > 0).join(totals, key).withColumn("share", F.col("w") / F.col("total"))
    by_type = weekly_curves(curves, "zone_type")
    return (
        shares.join(small(by_type), "zone_type")
        .groupBy(key, "weekday", "hour")
        .agg(F.sum(F.col("share") * F.col("value")).alias("value"))
    )


def resolve_profiles(zones: DataFrame, by_radio: DataFrame, by_barrio: DataFrame) -> DataFrame:
    """Profile of each zone text: tract code, else zone type, else neighbourhood, else the
    default. `zones` has `zone`; both tables have `key` and demand_multiplier, zone_type."""
    z = zones.withColumn("_code", F.trim("zone"))
    types = F.create_map(*[x for k, v in BASE_MULTIPLIERS.items() for x in (F.lit(k), F.lit(v))])
    r = by_radio.select(F.col("key").alias("_r"), F.col("demand_multiplier").alias("rm"), F.col("zone_type").alias("rz"))
    b = by_barrio.select(F.upper(F.trim("key")).alias("_b"), F.col("demand_multiplier").alias("bm"), F.col("zone_type").alias("bz"))
    rows = z.join(r, F.col("_code") == F.col("_r"), "left").join(b, F.upper("_code") == F.col("_b"), "left")
    own = types[F.lower("_code")]
    return rows.select(
        *zones.columns,
        F.when(F.col("_r").isNotNull(), "radio").when(own.isNotNull(), "zone_type").when(F.col("_b").isNotNull(), "barrio").otherwise("default").alias("resolved_by"),
        F.when(F.col("_r").isNotNull(), F.col("rz")).when(own.isNotNull(), F.lower("_code")).when(F.col("_b").isNotNull(), F.col("bz")).otherwise("residential_multifamily").alias("zone_type"),
        F.when(F.col("_r").isNotNull(), F.col("rm")).when(own.isNotNull(), own).when(F.col("_b").isNotNull(), F.col("bm")).otherwise(F.lit(1.0)).alias("demand_multiplier"),
    )


def ramp(start: Column, target: Column, now: Column, begins: Column, ends: Column) -> Column:
    """Control value moving linearly from start to target; the target when undated."""
    span = times.hours_between(begins, ends)
    part = times.hours_between(begins, now) / span
    undated = now.isNull() | begins.isNull() | ends.isNull()
    return (
        F.when(undated | (span <= 0) | (now >= ends), target).when(now <= begins, start).otherwise(start + (target - start) * part)
    )


def demand_listing(neighborhoods: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """Neighbourhoods with their effective multiplier (one without an override)."""
    value = ramp(F.col("multiplier_start"), F.col("multiplier_target"), now, F.col("begins"), F.col("ends"))
    o = overrides.select(F.col("neighborhood").alias("name"), value.alias("m"))
    return neighborhoods.join(small(o), "name", "left").withColumn("multiplier_effective", F.coalesce("m", F.lit(1.0))).drop("m")


def zone_multipliers(containers: DataFrame, profiles: DataFrame, curves: DataFrame, factor: DataFrame, overrides: DataFrame) -> DataFrame:
    """Demand of each container at its (weekday, hour): zone volume times curve times
    calibration times the neighbourhood's override.

    Containers: id, key, weekday, hour; profiles: key, demand_multiplier, barrio;
    overrides: neighborhood, multiplier.
    """
    o = overrides.select(text.neighbourhood_key(F.col("neighborhood")).alias("_n"), "multiplier")
    rows = containers.join(profiles.select("key", "demand_multiplier", "barrio"), "key").join(curves, ["key", "weekday", "hour"], "left")
    rows = attach(rows, factor).withColumn("_n", text.neighbourhood_key(F.col("barrio"))).join(small(o), "_n", "left")
    return rows.select(
        "id", "weekday", "hour",
        (F.col("demand_multiplier") * F.coalesce("value", F.lit(1.0)) * F.col("calibration") * F.coalesce("multiplier", F.lit(1.0))).alias("zone_mult"),
    )


def spill_over(containers: DataFrame, opposing: DataFrame) -> DataFrame:
    """Levels after one step. What does not fit goes in equal parts to the opposite site's
    containers of the same waste, else to all of them; capped at 100, not passed on.

    Containers: id, site_id, waste_type, level, increment; opposing: site_id, opposing_id.
    Spills sum per (site, waste) first, so no pair of containers is ever formed.
    """
    level, plus = F.col("level"), F.col("increment")
    excess = F.when(level >= 100, plus).when(level + plus > 100, level + plus - 100).otherwise(F.lit(0.0))
    out = (
        containers.withColumn("excess", excess)
        .where(F.col("excess") > 0)
        .join(opposing, "site_id")
        .groupBy(F.col("opposing_id").alias("to_site"), "waste_type")
        .agg(F.sum("excess").alias("excess"))
    )
    same = containers.groupBy(F.col("site_id").alias("to_site"), "waste_type").agg(F.count("*").alias("n_same"))
    every = containers.groupBy(F.col("site_id").alias("to_site")).agg(F.count("*").alias("n_all"))
    routed = out.join(same, ["to_site", "waste_type"], "left").join(every, "to_site", "left")
    to_same = routed.where(F.col("n_same").isNotNull()).select(
        F.col("to_site").alias("site_id"), "waste_type", (F.col("excess") / F.col("n_same")).alias("same_share")
    )
    to_all = (
        routed.where(F.col("n_same").isNull() & F.col("n_all").isNotNull())
        .groupBy(F.col("to_site").alias("site_id"))
        .agg(F.sum(F.col("excess") / F.col("n_all")).alias("all_share"))
    )
    rows = containers.join(to_same, ["site_id", "waste_type"], "left").join(to_all, "site_id", "left")
    added = F.coalesce("same_share", F.lit(0.0)) + F.coalesce("all_share", F.lit(0.0))
    return rows.select("id", "site_id", F.least(F.lit(100.0), level + plus + added).alias("level"))


def site_demand(containers: DataFrame) -> DataFrame:
    """Demand and zone of each site, those of its first container; a container without a
    site stands for its own. Containers: id, seq, site_id, demand, zone."""
    site = F.coalesce(F.col("site_id").cast("string"), F.concat(F.lit("SITE-"), "id"))
    return (
        containers.withColumn("site", site)
        .groupBy("site")
        .agg(F.min_by(F.struct("demand", "zone"), "seq").alias("f"))
        .select("site", "f.demand", "f.zone")
    )


def route_schedule(stops: DataFrame, hours: list[int]) -> DataFrame:
    """(route_id, site_id, position, hour): stops in route order spread over the collection
    hours, which start at 18; a short route visits every stop in every hour.

    Stops: route_id, site_id, stop_order.
    """
    ordered = sorted(hours, key=lambda h: (h - 18) % 24)
    count = len(ordered)
    by_route = Window.partitionBy("route_id").orderBy("stop_order", "site_id")
    rows = stops.withColumn("position", F.row_number().over(by_route) - 1)
    totals = stops.groupBy("route_id").agg(F.count("*").alias("total"))
    rows = rows.join(totals, "route_id")
    # Slot k holds positions from int(k * total / count) up to the next one.
    first = F.expr(f"(position * {count}) div total")
    here = F.when(F.floor((first + 1) * F.col("total") / count) <= F.col("position"), first + 1).otherwise(first)
    names = F.array(*[F.lit(h) for h in ordered])
    when = F.when(F.col("total") <= count, names).otherwise(F.array(F.element_at(names, (here + 1).cast("int"))))
    return rows.select("route_id", "site_id", "position", F.explode(when).alias("hour"))


def nearest_neighbour_order(stops: DataFrame, entrance: tuple[float, float]) -> DataFrame:
    """Visit order of one small circuit per route, always going to the closest stop left,
    from the entrance. Each route is one vehicle's round of a neighbourhood."""
    import numpy as np
    import pandas as pd

    start_lat, start_lon = entrance

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("site_id").reset_index(drop=True)
        left = np.ones(len(frame), dtype=bool)
        lat, lon = frame["latitude"].to_numpy(), frame["longitude"].to_numpy()
        y, x, order = start_lat, start_lon, np.empty(len(frame), dtype="int64")
        for step in range(len(frame)):
            gap = np.where(left, np.hypot(lat - y, lon - x), np.inf)
            pick = int(gap.argmin())
            left[pick], order[pick] = False, step
            y, x = lat[pick], lon[pick]
        return pd.DataFrame({"route_id": frame["route_id"], "site_id": frame["site_id"], "stop_order": order})

    types = dict(stops.dtypes)
    schema = f"route_id {types['route_id']}, site_id {types['site_id']}, stop_order bigint"
    return stops.select("route_id", "site_id", "latitude", "longitude").groupBy("route_id").applyInPandas(walk, schema)
