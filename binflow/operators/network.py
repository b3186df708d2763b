"""The network now: enrichment, site levels, KPIs, clusters and change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.functions import levels
from binflow.functions.text import id_suffix
from binflow.functions.numbers import half_even, half_up
from binflow.operators.filters import active
from binflow.session import small


def with_dimensions(containers: DataFrame, types: DataFrame, links: DataFrame, wastes: DataFrame, neighborhoods: DataFrame, sites: DataFrame) -> DataFrame:
    """Containers with nested type, the type's waste kinds, neighbourhood and site name."""
    kinds = (
        links.join(wastes.withColumnRenamed("id", "waste_type_id"), "waste_type_id")
        .groupBy("container_type_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("waste_type_id").alias("id"), "name", "color"))).alias("waste_types"))
    )
    nested = types.join(kinds, types["id"] == kinds["container_type_id"], "left").select(
        F.col("id").alias("container_type_id"),
        F.struct("id", "name", "height_cm", "volume_m3", F.coalesce("waste_types", F.array()).alias("waste_types")).alias("container_type"),
    )
    places = neighborhoods.select(F.col("id").alias("neighborhood_id"), F.col("name").alias("neighborhood"))
    names = sites.select(F.col("id").alias("site_id"), F.col("name").alias("site_name"))
    return (
        active(containers)
        .join(small(nested), "container_type_id", "left")
        .join(small(places), "neighborhood_id", "left")
        .join(small(names), "site_id", "left")
        .withColumn("effective_site_id", F.coalesce(F.col("site_id").cast("string"), "serie_id", F.col("id").cast("string")))
    )


def level_rollup(level: Column, how: str = "avg") -> Column:
    """Site level of its containers: rounded mean or maximum, zero without containers."""
    rolled = F.max(level).cast("double") if how == "max" else half_up(F.avg(level), 0)
    return F.coalesce(rolled, F.lit(0.0)).cast("int")


def site_containers(sites: DataFrame, containers: DataFrame, wastes: DataFrame) -> DataFrame:
    """Every active site with each active container (or none) and its waste type."""
    c = active(containers).select(
        "site_id", F.col("id").alias("container_id"), "current_level", "available", "last_reading", "last_pickup", "serie_id"
    )
    w = wastes.select(F.col("id").alias("waste_type_id"), F.col("name").alias("waste_type_name"))
    return (
        active(sites)
        .withColumnRenamed("id", "site_id")
        .join(c, "site_id", "left")
        .join(small(w), "waste_type_id", "left")
    )


def site_states(sites: DataFrame, containers: DataFrame, wastes: DataFrame, how: str = "avg") -> DataFrame:
    """Map output: one row per active site with its rolled-up level, times, and the
    list of its containers. Containers aggregate before they meet the sites."""
    rolled = (
        active(containers)
        .groupBy("site_id")
        .agg(
            level_rollup(F.col("current_level"), how).alias("current_level"),
            F.count("*").alias("container_count"),
            F.max("last_reading").alias("last_reading"),
            F.max("last_pickup").alias("last_pickup"),
            F.bool_or("available").alias("available"),
            F.array_sort(F.collect_list(F.struct("id", "serie_id", "current_level"))).alias("containers"),
        )
    )
    w = wastes.select(F.col("id").alias("waste_type_id"), F.col("name").alias("waste_type_name"))
    empty = F.array().cast("array<struct<id:bigint,serie_id:string,current_level:int>>")
    return (
        active(sites)
        .withColumnRenamed("id", "site_id")
        .join(rolled, "site_id", "left")
        .join(small(w), "waste_type_id", "left")
        .withColumn("current_level", F.coalesce("current_level", F.lit(0)))
        .withColumn("container_count", F.coalesce("container_count", F.lit(0).cast("bigint")))
        .withColumn("available", F.coalesce("available", F.lit(True)))
        .withColumn("containers", F.coalesce("containers", empty))
    )


def site_levels(sites: DataFrame, containers: DataFrame, level: str = "current_level") -> DataFrame:
    """Mean level and container count of every active site, zero when empty."""
    rolled = containers.groupBy("site_id").agg(
        F.avg(level).alias("avg_level"), F.count("*").alias("container_count")
    )
    return (
        active(sites)
        .select(F.col("id").alias("site_id"))
        .join(rolled, "site_id", "left")
        .select(
            "site_id",
            F.coalesce("avg_level", F.lit(0.0)).alias("avg_level"),
            F.coalesce("container_count", F.lit(0).cast("bigint")).alias("container_count"),
        )
    )


def network_kpis(site_level: DataFrame, t: levels.Thresholds = levels.DEFAULT) -> DataFrame:
    """One row: totals, mean, population deviation and category counts over sites."""
    level = F.col("avg_level")
    category = levels.level_category(level, t)
    counts = [F.count_if(category == name).alias(f"{name}_count") for name in levels.CATEGORIES]
    mean, mean_sq = F.coalesce(F.avg(level), F.lit(0.0)), F.coalesce(F.avg(level * level), F.lit(0.0))
    return site_level.agg(
        F.count("*").alias("total_sites"),
        F.coalesce(F.sum("container_count"), F.lit(0).cast("bigint")).alias("total_containers"),
        half_even(mean, 2).alias("mean_fill_level"),
        half_even(F.sqrt(F.greatest(F.lit(0.0), mean_sq - mean * mean)), 2).alias("std_fill_level"),
        *counts,
    )


def compare_kpis(real: DataFrame, planned: DataFrame) -> DataFrame:
    """Two one-row KPI frames side by side with the improvement figures."""
    a = real.select(*[F.col(c).alias(f"real_{c}") for c in real.columns], F.lit(1).alias("one"))
    b = planned.select(*[F.col(c).alias(f"plan_{c}") for c in planned.columns], F.lit(1).alias("one"))
    gap = F.col("real_std_fill_level") - F.col("plan_std_fill_level")
    return (
        a.join(b, "one")
        .drop("one")
        .withColumn(
            "std_reduction_pct",
            F.when(F.col("real_std_fill_level") > 0, half_even(gap / F.col("real_std_fill_level") * 100, 2)).otherwise(F.lit(0.0)),
        )
        .withColumn(
            "critical_sites_reduction",
            F.greatest(F.lit(0).cast("bigint"), F.col("real_critical_count") - F.col("plan_critical_count")),
        )
        .withColumn("is_improved", gap > 0.05)
    )


def critical_and_full(site_level: DataFrame, containers: DataFrame, level: str = "current_level", t: levels.Thresholds = levels.DEFAULT) -> DataFrame:
    """Critical sites and full containers as one row."""
    critical = site_level.agg(F.count_if(F.col("avg_level") >= t.critical).alias("critical_sites"), F.lit(1).alias("one"))
    full = containers.agg(F.count_if(F.col(level) >= t.full).alias("full_containers"), F.lit(1).alias("one"))
    return critical.join(full, "one").drop("one")


def container_stats(containers: DataFrame, t: levels.Thresholds = levels.DEFAULT) -> DataFrame:
    level = F.col("current_level")
    return active(containers).agg(
        F.count("*").alias("total"),
        F.count_if("available").alias("available"),
        F.count_if(level >= t.critical).alias("alert_level"),
        F.coalesce(half_even(F.avg(level), 0), F.lit(0.0)).cast("int").alias("avg_fill"),
    )


# Cluster cell in degrees below each zoom; points from zoom 17 on.
ZOOM_CELLS = ((11, 0.15), (13, 0.05), (15, 0.015), (17, 0.003))


def cluster_cell(zoom: int) -> float | None:
    return next((size for below, size in ZOOM_CELLS if zoom < below), None)


def _cell_index(value: Column, size: float) -> Column:
    return F.round(value / F.lit(size), 0).cast("bigint")


def site_clusters(site_container: DataFrame, zoom: int, how: str = "avg") -> DataFrame:
    """Map clusters of `site_containers` rows; None-sized zooms return nothing to group."""
    size = cluster_cell(zoom)
    if size is None:
        raise ValueError("from zoom 17 on, show points instead of clusters")
    return (
        site_container.groupBy(
            _cell_index(F.col("latitude"), size).alias("cell_y"), _cell_index(F.col("longitude"), size).alias("cell_x")
        )
        .agg(
            F.avg("latitude").alias("cluster_lat"),
            F.avg("longitude").alias("cluster_lng"),
            F.count("container_id").alias("container_count"),
            level_rollup(F.col("current_level"), how).alias("avg_level"),
            F.coalesce(F.max("current_level"), F.lit(0)).alias("max_level"),
            F.count_if("available").alias("available_count"),
        )
        .withColumn(
            "cluster_id",
            F.concat(F.lit("site_cluster_"), F.format_string("%.5f", "cluster_lat"), F.lit("_"), F.format_string("%.5f", "cluster_lng")),
        )
    )


def container_clusters(containers: DataFrame, zoom: int) -> DataFrame:
    size = cluster_cell(zoom)
    if size is None:
        raise ValueError("from zoom 17 on, show points instead of clusters")
    return (
        active(containers)
        .groupBy(_cell_index(F.col("latitude"), size).alias("cell_y"), _cell_index(F.col("longitude"), size).alias("cell_x"))
        .agg(
            F.avg("latitude").alias("latitude"),
            F.avg("longitude").alias("longitude"),
            F.count("*").alias("total"),
            F.coalesce(half_up(F.avg("current_level"), 0), F.lit(0.0)).cast("int").alias("avg_level"),
        )
    )


def site_level_history(readings: DataFrame, containers: DataFrame, last: int = 168, until=None) -> DataFrame:
    """Per site the newest `last` reading instants with their level statistics.

    Readings collapse to instants first; the rank then prunes inside each task
    before the shuffle, so a site with very many instants costs no more than others.
    """
    homes = active(containers).select(F.col("id").alias("container_id"), "site_id")
    r = readings.drop("site_id").where(F.col("level").isNotNull())
    if until is not None:
        r = r.where(F.col("reading_date") <= F.lit(until))
    instants = (
        r.join(small(homes), "container_id")
        .groupBy("site_id", "reading_date")
        .agg(
            half_up(F.avg("level"), 2).alias("avg_level"),
            F.max("level").alias("max_level"),
            F.min("level").alias("min_level"),
            F.count("*").alias("measurement_count"),
        )
    )
    newest = Window.partitionBy("site_id").orderBy(F.col("reading_date").desc())
    return instants.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= last).drop("rank")


def changes(containers: DataFrame, after: int, limit: int, after_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Change feed page and its cursor row.

    Rows after the cursor (version, id), oldest first, at most `limit`; without an id, rows of
    later versions. The next cursor is the last row's version and id when the page is full,
    else the latest version and no id. Rows that share a version are thus never skipped.
    """
    alive = active(containers)
    later = F.col("change_version") > after
    if after_id is not None:
        later = later | ((F.col("change_version") == after) & (F.col("id") > after_id))
    page = alive.where(later).orderBy("change_version", "id").limit(limit)
    seen = page.agg(F.count("*").alias("n"), F.max(F.struct("change_version", "id")).alias("last"), F.lit(1).alias("one"))
    latest = alive.agg(F.coalesce(F.max("change_version"), F.lit(after)).alias("latest"), F.lit(1).alias("one"))
    full = F.col("n") >= limit
    cursor = seen.join(latest, "one").select(
        F.when(full, F.col("last.change_version")).otherwise(F.col("latest")).alias("cursor"),
        F.when(full, F.col("last.id")).alias("cursor_id"),
        F.col("n").alias("returned"),
        full.alias("has_more"),
    )
    return page, cursor


def changed_sites(sites: DataFrame, containers: DataFrame, after: int) -> DataFrame:
    """Active sites with at least one container changed after a version."""
    moved = active(containers).where((F.col("change_version") > after) & F.col("site_id").isNotNull()).select("site_id")
    return active(sites).join(moved, F.col("id") == F.col("site_id"), "left_semi")


def site_changes(sites: DataFrame, containers: DataFrame, after: int, limit: int, after_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Site form of the change feed: a page of active sites by the latest version among their
    containers, and its cursor row (latest_cursor, cursor_id, has_more)."""
    latest = active(containers).where(F.col("site_id").isNotNull()).groupBy("site_id").agg(F.max("change_version").alias("change_version"))
    placed = active(sites).drop("change_version").join(latest, F.col("id") == F.col("site_id")).drop("site_id")
    page, cursor = changes(placed, after, limit, after_id)
    return page, cursor.select(F.col("cursor").alias("latest_cursor"), "cursor_id", "has_more")


def page(df: DataFrame, number: int, size: int, key: str = "id") -> DataFrame:
    """One page in key order. For deep pages prefer `page_after`, which never counts
    through the rows before it."""
    return df.orderBy(key).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, last_key: int, size: int, key: str = "id") -> DataFrame:
    return df.where(F.col(key) > last_key).orderBy(key).limit(size)


def map_extent(sites: DataFrame, containers: DataFrame, wastes: DataFrame) -> DataFrame:
    """Bounds and centre over sites, or over containers when there is no site."""

    def extent(df: DataFrame, rank: int) -> DataFrame:
        return df.agg(
            F.min("latitude").alias("lat_min"),
            F.max("latitude").alias("lat_max"),
            F.min("longitude").alias("lng_min"),
            F.max("longitude").alias("lng_max"),
            F.avg("latitude").alias("center_lat"),
            F.avg("longitude").alias("center_lng"),
            F.count("*").alias("entities"),
        ).withColumn("rank", F.lit(rank))

    both = extent(active(sites), 0).unionByName(extent(active(containers), 1)).where(F.col("entities") > 0)
    columns = ("lat_min", "lat_max", "lng_min", "lng_max", "center_lat", "center_lng", "entities")
    chosen = both.agg(F.min_by(F.struct(*columns), "rank").alias("e"), F.lit(1).alias("one"))
    w = wastes.select(F.col("id").alias("waste_type_id"), F.col("name").alias("waste_name"))
    name = F.lower(F.coalesce("waste_name", F.lit("húmeda")))
    kinds = (
        active(sites)
        .join(small(w), "waste_type_id", "left")
        .agg(
            F.coalesce(F.bool_or(F.contains(name, F.lit("húmed"))), F.lit(False)).alias("wet"),
            F.coalesce(F.bool_or(F.contains(name, F.lit("seca"))), F.lit(False)).alias("dry"),
            F.lit(1).alias("one"),
        )
    )
    none = ~(F.col("wet") | F.col("dry"))
    return chosen.join(kinds, "one").select(
        "e.*", (F.col("wet") | none).alias("has_organico"), (F.col("dry") | none).alias("has_reciclaje")
    )


def resolve_identity(telemetry: DataFrame, containers: DataFrame) -> DataFrame:
    """Attach the container a message belongs to; unresolved rows keep a null id.

    Order: numeric suffix of the raw id, suffix or whole serie id, whole raw id as a
    serie id, device. Two containers sharing a key: the largest id wins.
    """
    known = containers.select("id", F.trim("serie_id").alias("serie_id"), "device_imei")
    series = known.select("id", F.explode(F.array("serie_id", id_suffix(F.col("serie_id")))).alias("serie_key"))
    series = series.where(F.col("serie_key").isNotNull()).groupBy("serie_key").agg(F.max("id").alias("serie_container"))
    devices = known.where(F.col("device_imei").isNotNull()).groupBy("device_imei").agg(F.max("id").alias("device_container"))
    suffix = F.coalesce(id_suffix(F.col("raw_container_id")), F.lit(""))
    t = telemetry.withColumn("id_text", suffix).withColumn(
        "id_number", F.when(F.regexp_like("id_text", F.lit(r"^\d+$")), F.col("id_text").try_cast("bigint"))
    )
    ids = known.select(F.col("id").alias("number_container"))
    whole = series.select(F.col("serie_key").alias("whole_key"), F.col("serie_container").alias("whole_container"))
    return (
        t.join(small(ids), t["id_number"] == F.col("number_container"), "left")
        .join(small(series), F.col("id_text") == F.col("serie_key"), "left")
        .join(small(whole), F.col("raw_container_id") == F.col("whole_key"), "left")
        .join(small(devices), t["device_id"] == devices["device_imei"], "left")
        .withColumn(
            "container_id", F.coalesce("number_container", "serie_container", "whole_container", "device_container")
        )
        .drop(
            "id_text", "id_number", "number_container", "serie_key", "serie_container",
            "whole_key", "whole_container", "device_imei", "device_container",
        )
    )


def nearest_fixed(df: DataFrame, places: list[tuple[str, float, float]], lat_scale: float = 111000.0, lon_scale: float = 91400.0) -> DataFrame:
    """Closest of a fixed short list of places (given as literals, no join at all)."""
    lat, lon = F.col("latitude"), F.col("longitude")
    options = []
    for rank, (name, y, x) in enumerate(places):
        dy, dx = (lat - y) * lat_scale, (lon - x) * lon_scale
        options.append(F.struct((dy * dy + dx * dx).alias("d"), F.lit(rank).alias("rank"), F.lit(name).alias("place")))
    return df.withColumn("nearest_place", F.array_min(F.array(*options))["place"])


def sites_of_interest(sites: DataFrame, containers: DataFrame, readings: DataFrame, start, end, critical: float = 80.0) -> DataFrame:
    """Active sites that touched the critical level in the window or hold two containers.

    One pass over the readings of the window, reduced to site ids before any join."""
    homes = active(containers).select(F.col("id").alias("container_id"), "site_id")
    counts = homes.groupBy("site_id").agg(F.count("*").alias("containers"))
    hot = (
        readings.where(F.col("reading_date").between(start, end) & (F.col("level") >= critical))
        .select("container_id")
        .distinct()
        .join(homes, "container_id")
        .select("site_id")
        .distinct()
        .withColumn("reached", F.lit(True))
    )
    return (
        active(sites)
        .withColumnRenamed("id", "site_id")
        .join(counts, "site_id")
        .join(hot, "site_id", "left")
        .where(F.coalesce("reached", F.lit(False)) | (F.col("containers") >= 2))
        .drop("reached")
    )


def latest_levels(readings: DataFrame, as_of) -> DataFrame:
    """Last level of every container at or before `as_of` (newest date, then id)."""
    return (
        readings.where((F.col("reading_date") <= F.lit(as_of)) & F.col("level").isNotNull())
        .groupBy("container_id")
        .agg(F.max_by("level", F.struct("reading_date", "id")).alias("level"))
    )


def latest_level_at(readings: DataFrame, moments: DataFrame) -> DataFrame:
    """As-of join: for every (container_id, moment) the newest reading at or before it.

    Readings and moments of a (container, day) run in one line, in which a moment takes the
    last level before it; no pairs are formed. Moments without one look back over day-level
    rows: the last level of each day and the days asked for run in one window per container,
    whose rows are days.
    """
    r = readings.where(F.col("level").isNotNull()).withColumn("day", F.to_date("reading_date"))
    m = moments.select("container_id", "moment").distinct().withColumn("day", F.to_date("moment"))
    lined = r.select("container_id", "day", F.col("reading_date").alias("moment"), F.lit(0).alias("asks"), "id", "level").unionByName(
        m.select("*", F.lit(1).alias("asks")), allowMissingColumns=True
    )
    line = Window.partitionBy("container_id", "day").orderBy("moment", "asks", "id").rowsBetween(Window.unboundedPreceding, 0)
    met = lined.withColumn("level", F.last("level", ignorenulls=True).over(line)).where(F.col("asks") == 1).select("container_id", "day", "moment", "level")
    same_day = met.where(F.col("level").isNotNull()).select("container_id", "moment", "level")
    rest = met.where(F.col("level").isNull()).drop("level")
    day_last = r.groupBy("container_id", "day").agg(F.max_by("level", F.struct("reading_date", "id")).alias("level"))
    asked = rest.select("container_id", "day").distinct().withColumn("level", F.lit(None).cast("int"))
    # A day asked for sorts before that day's own level, so it sees earlier days only.
    days = day_last.withColumn("kind", F.lit(1)).unionByName(asked.withColumn("kind", F.lit(0)))
    order = Window.partitionBy("container_id").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, -1)
    answers = days.withColumn("level", F.last("level", ignorenulls=True).over(order)).where(F.col("kind") == 0).drop("kind")
    earlier = rest.join(answers, ["container_id", "day"]).where(F.col("level").isNotNull()).select("container_id", "moment", "level")
    return same_day.unionByName(earlier)
