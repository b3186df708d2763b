"""CSV inputs: curb segments, census tracts, populations, routes, parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.functions import geo, text


def _csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", separator).option("multiLine", False).option("quote", '"').option("escape", '"').csv(path)


def _pick(df: DataFrame, *names: str) -> Column:
    """First non-empty of the columns that exist; null when none does."""
    present = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def _starting(df: DataFrame, prefix: str) -> Column:
    name = next((c for c in df.columns if c.startswith(prefix)), None)
    return F.lit(None).cast("string") if name is None else F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))


def segment_capacities(spark: SparkSession, path: str) -> DataFrame:
    """segment_id, capacity, line; rows without a valid line or capacity dropped; capacity
    two when the file has no capacity column. Without a segment_id column the id is a hash of
    the row's capacity and line, which no split of the file changes."""
    df = _csv(spark, path, ";")
    wkt = F.col("geometry_wkt") if "geometry_wkt" in df.columns else F.col("WKT")
    capacity = F.col("MAX_CONTENEDORES").try_cast("double").cast("int") if "MAX_CONTENEDORES" in df.columns else F.lit(2)
    number = F.col("segment_id").try_cast("bigint") if "segment_id" in df.columns else F.xxhash64(capacity, wkt)
    rows = df.select(number.alias("segment_id"), capacity.alias("capacity"), geo.line_from_wkt(wkt).alias("line"))
    return rows.where(F.col("line").isNotNull() & F.col("capacity").isNotNull())


def census_tracts(spark: SparkSession, path: str) -> DataFrame:
    """Tracts with polygon, population, area and centroid; unreadable numbers are zero."""
    df = _csv(spark, path)

    def number(*names: str) -> Column:
        return F.coalesce(_pick(df, *names).try_cast("double"), F.lit(0.0))

    wkt = _pick(df, "Geometría en WKT")
    # The total wins when present, even if unreadable: it then counts as zero.
    people = _pick(df, "Población total", "Población total (en hogares familiares)").try_cast("double")
    rows = df.select(
        F.coalesce(_pick(df, "Código de radio"), F.lit("")).alias("radio_code"),
        F.coalesce(_pick(df, "Nombre de departamento"), F.lit("")).alias("department_name"),
        F.coalesce(people, F.lit(0.0)).cast("bigint").alias("population"),
        number("Superficie en km2").alias("area_km2"),
        number("Latitud del centroide").alias("centroid_lat"),
        number("Longitud del centroide").alias("centroid_lon"),
        geo.polygon_from_wkt(wkt).alias("rings"),
    )
    return rows.where(F.col("rings").isNotNull())


def populations(spark: SparkSession, path: str, year: int = 2010, source: str = "Censo 2010") -> DataFrame:
    df = _csv(spark, path)
    if not {"barrio", "poblacion"} <= set(df.columns):
        raise ValueError("the file needs the columns barrio and poblacion")
    return df.select(
        "barrio", text.neighbourhood_key(F.col("barrio")).alias("key"), F.col("poblacion").cast("bigint").alias("population"),
        F.lit(year).alias("year"), F.lit(source).alias("source"),
    )


def route_segments(spark: SparkSession, path: str) -> DataFrame:
    """Collection route segments in file order, columns found by prefix.

    `route_rank` is the first row of the route and `segment` the row itself, so both
    order as the file does; the id keeps the part before the dot.
    """
    df = _csv(spark, path).withColumn("row", F.monotonically_increasing_id())
    start = F.coalesce(_starting(df, "alt_izqini").try_cast("double").cast("int"), F.lit(0))
    rows = df.select(
        F.trim(F.split(_starting(df, "cod_ruta_d"), r"\.")[0]).alias("route_id"),
        F.col("row").alias("segment"),
        text.repair_enie(F.coalesce(_starting(df, "nomoficial"), F.lit(""))).alias("street_name"),
        start.alias("alt_start"),
        F.coalesce(_starting(df, "alt_derfin").try_cast("double").cast("int"), start + 100).alias("alt_end"),
        F.coalesce(_starting(df, "sentido"), F.lit("Creciente")).alias("direction"),
        F.coalesce(_starting(df, "nom_servic"), F.lit("Recoleccion Domiciliaria")).alias("service_name"),
        F.coalesce(_starting(df, "long").try_cast("double"), F.lit(100.0)).alias("length_m"),
        F.coalesce(_starting(df, "zona").try_cast("double").cast("int"), F.lit(3)).alias("zone"),
        F.coalesce(_starting(df, "comuna"), F.lit("")).alias("commune"),
        F.coalesce(_starting(df, "barrio"), F.lit("")).alias("neighborhood"),
    ).where(F.coalesce("route_id", F.lit("")) != "")
    ranks = rows.groupBy("route_id").agg(F.min("segment").alias("route_rank"))
    return rows.join(ranks, "route_id")


def parcels(spark: SparkSession, path: str) -> DataFrame:
    """Active parcels of the land-use survey; the door is null when not a number."""
    df = _csv(spark, path)
    rows = df.where(F.upper(F.trim("ESTADO")) == "ACTIVO")
    return rows.select(
        F.upper(F.trim(F.coalesce("BARRIO", F.lit("")))).alias("barrio"), F.coalesce("CALLE", F.lit("")).alias("street"),
        F.when(F.regexp_like(F.trim("PUERTA"), F.lit(r"^\d+$")), F.trim("PUERTA").cast("int")).alias("number"),
        *[F.coalesce(c.upper(), F.lit("")).alias(c) for c in ("tipo1", "tipo2", "pisos")],
    )


def count_check(source: DataFrame, loaded: DataFrame, key: str = "file") -> DataFrame:
    """Rows per input against rows loaded, with what is missing."""
    s = source.groupBy(key).agg(F.count("*").alias("source_rows"))
    t = loaded.groupBy(key).agg(F.count("*").alias("loaded_rows"))
    rows = s.join(t, key, "left").withColumn("loaded_rows", F.coalesce("loaded_rows", F.lit(0)))
    return rows.withColumn("missing", F.col("source_rows") - F.col("loaded_rows")).withColumn("complete", F.col("missing") == 0)
