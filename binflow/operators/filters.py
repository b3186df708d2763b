"""Row filters and row-level derivations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binflow.functions import levels, text
from binflow.functions.numbers import half_even

def active(df: DataFrame) -> DataFrame:
    """Rows not soft deleted; filter before an outer join so its left side survives."""
    return df.where(F.col("deleted_at").isNull())


def in_box(df: DataFrame, south: float, north: float, west: float, east: float, closed: bool = True) -> DataFrame:
    """Coordinates in a box. `closed` keeps the boundary (sites); containers drop it."""
    lat, lon = F.col("latitude"), F.col("longitude")
    if closed:
        return df.where(lat.between(south, north) & lon.between(west, east))
    return df.where((lat > south) & (lat < north) & (lon > west) & (lon < east))


def waste_kind(df: DataFrame, kind: str, column: str = "waste_type_name") -> DataFrame:
    """`all`, `humedo` or `reciclable`; a missing waste name counts as wet."""
    if kind == "all":
        return df
    if kind == "reciclable":
        return df.where(F.lower(F.coalesce(F.col(column), F.lit(""))).like("%seca%"))
    if kind == "humedo":
        return df.where(F.lower(F.coalesce(F.col(column), F.lit("húmeda"))).like("%húmed%"))
    raise ValueError(f"unknown waste kind {kind}")


def search(
    df: DataFrame,
    words: str | None = None,
    type_name: str | None = None,
    alerts_only: bool = False,
    thresholds: levels.Thresholds = levels.DEFAULT,
) -> DataFrame:
    """Case-insensitive contains over site id, site name, neighbourhood and id."""
    if words:
        pattern = f"%{words}%"
        df = df.where(
            F.col("site_id").cast("string").ilike(pattern)
            | F.col("site_name").ilike(pattern)
            | F.col("neighborhood").ilike(pattern)
            | F.col("id").cast("string").ilike(pattern)
        )
    if type_name and type_name != "all":
        df = df.where(F.col("container_type").ilike(f"%{type_name}%"))
    if alerts_only:
        df = df.where(F.col("current_level") >= thresholds.critical)
    return df


def alarms(measurements: DataFrame, keep: Sequence[str] = ("timestamp", "container_id")) -> DataFrame:
    """Measurements that raise an alarm, with its type and severity. Stateless, so it
    runs unchanged on a stream."""
    hit = levels.alarm(*(F.col(c) for c in ("fill_level_pct", "temperature_c", "battery_pct", "signal_rssi_dbm", "anomaly")))
    return (
        measurements.select(*keep, hit.alias("alarm"))
        .where(F.col("alarm").isNotNull())
        .select(*keep, "alarm.alarm_type", "alarm.severity")
    )


def container_type_name(file_name: Column, equipment: Column) -> Column:
    """Container type of a seed feature from its file and equipment code."""
    # The four container types.
    return (
        F.when(file_name == "contenedores_verdes.json", "Lateral Fracción Seca")
        .when(equipment == "BILATERAL", "Bilateral Fracción Húmeda")
        .when(equipment == "SOTERRADO", "Soterrado Fracción Húmeda")
        .otherwise("Lateral Fracción Húmeda")
    )


def parcel_category(kind: Column, subkind: Column, floors: Column) -> Column:
    """Land use of a parcel from its survey columns."""
    k, s = F.upper(F.trim(kind)), F.upper(F.trim(subkind))
    f = F.trim(floors)
    tall = (F.regexp_like(f, F.lit(r"^\d+$")) & (f.try_cast("int") > 2)) | F.startswith(f, F.lit(">")) | F.contains(f, F.lit("+"))
    home = (
        F.when(s == "MULTIFAMILIAR", "residential_multifamily")
        .when(s == "UNIFAMILIAR", "residential_singlefamily")
        .when(tall, "residential_multifamily")
        .otherwise("residential_singlefamily")
    )
    # Survey codes of each use.
    return (
        F.when(k.isin("RESIDENCIAL", "BARRIO POPULAR"), home)
        .when(k.isin("UNICOMERCIAL", "MULTICOMERCIAL", "GARAGE COMERCIAL", "ESTACION DE SERVICIO"), "commercial")
        .when(k.isin("OFICINAS", "EQUIPAMIENTO"), "office")
        .when(k == "INDUSTRIAL", "industrial")
        .otherwise("other")
    )


# Classification bounds in percent of parcels.
ZONE_BOUNDS = {"industrial": 25.0, "office": 15.0, "commercial": 30.0, "dominant": 35.0, "combined": 40.0}


def zone_type(multi: Column, single: Column, commercial: Column, office: Column, industrial: Column, bounds: dict[str, float] = ZONE_BOUNDS) -> Column:
    multi_name, single_name = "residential_multifamily", "residential_singlefamily"
    larger = F.when(multi >= single, multi_name).otherwise(single_name)
    return (
        F.when(industrial > bounds["industrial"], "industrial")
        .when(office > bounds["office"], "office")
        .when(commercial > bounds["commercial"], "commercial")
        .when((multi > bounds["dominant"]) & (multi >= single), multi_name)
        .when((single > bounds["dominant"]) & (single > multi), single_name)
        .when(multi + single > bounds["combined"], larger)
        .otherwise("mixed")
    )


def telemetry_to_readings(resolved: DataFrame) -> DataFrame:
    """Reading columns of telemetry whose container is already resolved."""
    level = F.bround(F.col("fill_level_pct"), 0).cast("int")
    return resolved.select(
        "*",
        level.alias("container_current_level"),
        half_even(F.col("volume_m3") * level / 100, 4).alias("container_current_m3"),
        F.coalesce(F.col("anomaly") == "incendio", F.lit(False)).alias("fire_alarm"),
        F.lit(False).alias("freeze_alarm"),
        (F.col("acceleration_g") >= 2.5).alias("crash_alarm"),
        (F.col("battery_pct") <= 15).alias("reported_low_consumption_voltage"),
        F.col("collected").alias("garbage_collection_alarm"),
        F.when(F.col("collected"), F.col("reading_date")).alias("reported_collection_date"),
        F.col("ultrasonic_distance_cm").alias("reported_height"),
    )


def quality_report(measurements: DataFrame) -> DataFrame:
    """One row of counts plus the list of broken rules, in one pass."""
    level, distance = F.col("fill_level_pct"), F.col("ultrasonic_distance_cm")
    totals = measurements.agg(
        F.count("*").alias("measurements"),
        F.coalesce(half_even(F.avg(level), 4), F.lit(0.0)).alias("avg_fill_level_pct"),
        F.coalesce(F.max(level), F.lit(0.0)).alias("max_fill_level_pct"),
        F.count_if((level < 0) | (level > 100)).alias("bad_levels"),
        F.count_if(distance < 0).alias("bad_distances"),
    )
    rules = F.array_compact(
        F.array(
            F.when(F.col("bad_levels") > 0, "level_out_of_range"),
            F.when(F.col("bad_distances") > 0, "negative_distance"),
            F.when(F.col("measurements") == 0, "no_measurements"),
        )
    )
    return totals.withColumn("errors", rules).withColumn("ok", F.size("errors") == 0)


def lookup(sites: DataFrame, containers: DataFrame, ids: DataFrame) -> DataFrame:
    """Resolve raw ids: the site with the numeric suffix, else the container with that
    id or serie id presented as a site of one container.

    `ids` has one column `raw_id`; output is one row per resolved id.
    """
    wanted = ids.select("raw_id", text.numeric_suffix(F.col("raw_id")).alias("number"))
    by_site = wanted.join(active(sites), wanted["number"] == F.col("id")).select(
        "raw_id", "id", F.lit("site").alias("kind"), "name", "address", "latitude", "longitude"
    )
    rest = wanted.join(by_site.select("raw_id"), "raw_id", "left_anti")
    alive = active(containers).select("id", "serie_id", "address", "latitude", "longitude")

    def as_site(matched: DataFrame) -> DataFrame:
        return matched.select(
            "raw_id", "id", F.lit("container").alias("kind"), F.col("serie_id").alias("name"), "address", "latitude", "longitude"
        )

    by_id = as_site(rest.join(alive, rest["number"] == F.col("id")))
    by_serie = as_site(
        rest.join(by_id.select("raw_id"), "raw_id", "left_anti").join(alive, F.col("raw_id") == F.col("serie_id"))
    )
    return by_site.unionByName(by_id).unionByName(by_serie)
