"""Checks of the file sources, over files that Spark writes from the benchmark tables, and of
the ingest's states in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow import adapter as a
from binflow.operators import readings as arrivals
from binflow.queries.duck import with_ctes
from binflow.queries.registry import query
from binflow.session import shared_folder
from binflow.sources import geojson, tables
from binflow.streaming import ingest


def _lines(spark: SparkSession, features: DataFrame) -> str:
    """The folder of newline-delimited features that Spark wrote."""
    folder = shared_folder(spark)
    features.select(F.to_json("f").alias("value")).write.text(folder)
    return folder


def _csv(spark: SparkSession, rows: DataFrame, separator: str = ",") -> str:
    folder = shared_folder(spark)
    rows.write.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').csv(folder)
    return folder


@query(
    "a02_container_features",
    "SELECT status, count(*) AS features FROM (SELECT CASE WHEN c_custkey % 17 = 0 THEN 'no_id' WHEN c_custkey % 11 = 3 THEN 'bad_geom' ELSE 'success' END AS status FROM customer UNION ALL SELECT 'duplicate' FROM customer WHERE c_custkey % 13 = 5 AND c_custkey % 17 <> 0) GROUP BY 1",
)
def _a02(spark, sf):
    """Customers as seed containers: some without an id, some without a point, some twice."""
    k = F.col("c_custkey")
    c = a.table(spark, sf, "customer").select("c_custkey")
    point = F.when(k % 11 == 3, F.array().cast("array<double>")).otherwise(F.array(F.lit(-58.4), F.lit(-34.6) + k * F.lit(1e-6)))
    feature = F.struct(
        F.struct(F.when(k % 17 != 0, k.cast("string")).alias("Id"), F.lit("LAT").alias("CodEquipa")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), point.alias("coordinates")).alias("geometry"),
    )
    twice = c.unionByName(c.where((k % 13 == 5) & (k % 17 != 0)))
    return geojson.import_counts(geojson.container_features(spark, _lines(spark, twice.select(feature.alias("f"))), "red", "RSU", lines=True))


@query(
    "a03_street_features",
    "SELECT 'LINEA ' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'DOBLE' WHEN s_suppkey % 3 = 1 THEN 'CRECIENTE' ELSE 'DECRECIENTE' END AS direction, CASE WHEN s_suppkey % 5 = 0 THEN 'AVENIDA' ELSE '' END AS street_type, 2 + s_suppkey % 3 AS points FROM supplier WHERE s_suppkey % 7 <> 6",
)
def _a03(spark, sf):
    """Suppliers as streets in mixed case; some are no lines."""
    k = F.col("s_suppkey")
    points = F.transform(F.sequence(F.lit(1), (k % 3 + 2).cast("int")), lambda i: F.array(i * 0.5, i * 0.25))
    feature = F.struct(
        F.struct(
            F.concat(F.lit(" Linea "), k).alias("nomoficial"), F.when(k % 3 == 1, "Creciente").when(k % 3 == 2, "decreciente ").alias("sentido"),
            F.when(k % 5 == 0, "avenida").alias("tipo_c"),
        ).alias("properties"),
        F.struct(F.when(k % 7 == 6, "MultiPoint").otherwise("LineString").alias("type"), points.alias("coordinates")).alias("geometry"),
    )
    folder = _lines(spark, a.table(spark, sf, "supplier").select(feature.alias("f")))
    s = geojson.street_features(spark, folder, lines=True)
    return s.select("name", "direction", "street_type", F.size("line").cast("bigint").alias("points"))


@query(
    "a04_capacity_file",
    "SELECT p_partkey AS segment_id, CAST(p_size % 9 AS INTEGER) AS capacity, 2 AS points, p_size / 2e0 AS first_x FROM part WHERE p_partkey % 10 <> 3 AND p_partkey % 6 <> 5",
)
def _a04(spark, sf):
    """Parts as street segments; some without a readable capacity or line."""
    k = F.col("p_partkey")
    wkt = F.when(k % 6 == 5, "POINT (1 1)").otherwise(F.format_string("LINESTRING (%s 1, 3 4.5)", (F.col("p_size") / 2).cast("string")))
    rows = a.table(spark, sf, "part").select(k.alias("segment_id"), F.when(k % 10 == 3, "x").otherwise((F.col("p_size") % 9).cast("string")).alias("MAX_CONTENEDORES"), wkt.alias("geometry_wkt"))
    s = tables.segment_capacities(spark, _csv(spark, rows, ";"))
    return s.select("segment_id", "capacity", F.size("line").alias("points"), F.col("line")[0]["x"].alias("first_x"))


@query(
    "a05_census_file",
    "SELECT 'R' || s_suppkey AS radio_code, 'Comuna ' || (s_suppkey % 5) AS department_name, CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 4 = 1 THEN 70 + s_suppkey ELSE 100 + s_suppkey END AS population, CASE WHEN s_suppkey % 3 = 0 THEN 0e0 ELSE s_suppkey / 2e0 END AS area_km2 FROM supplier WHERE s_suppkey % 9 <> 8",
)
def _a05(spark, sf):
    """Suppliers as census tracts with missing and unreadable numbers."""
    k = F.col("s_suppkey")
    rows = a.table(spark, sf, "supplier").select(
        F.concat(F.lit("R"), k).alias("Código de radio"), F.concat(F.lit("Comuna "), k % 5).alias("Nombre de departamento"),
        F.when(k % 9 != 8, "POLYGON ((0 0, 1 0, 1 1, 0 0))").alias("Geometría en WKT"),
        F.when(k % 4 == 0, "?").when(k % 4 != 1, (k + 100).cast("string")).alias("Población total"), (k + 70).alias("Población total (en hogares familiares)"),
        F.when(k % 3 == 0, "x").otherwise((k / 2).cast("string")).alias("Superficie en km2"),
    )
    return tables.census_tracts(spark, _csv(spark, rows)).select("radio_code", "department_name", "population", "area_km2")


@query("a06_population_file", "SELECT n_name AS barrio, lower(n_name) AS key, CAST(1000 + n_nationkey AS BIGINT) AS population FROM nation")
def _a06(spark, sf):
    rows = a.table(spark, sf, "nation").select(F.col("n_name").alias("barrio"), (F.col("n_nationkey") + 1000).alias("poblacion"))
    return tables.populations(spark, _csv(spark, rows)).select("barrio", "key", "population")


_FINAL = "SELECT container_id, arg_max(level, {'d': reading_date, 's': -id}) AS current_level, max(reading_date) AS last_reading"


def _ingested(spark, sf):
    """All readings in two batches by arrival, each on the states that the one before left."""
    r = a.readings(spark, sf)
    half = (r.agg(F.max("id")).first()[0] or 0) // 2
    empty = a.containers(spark, sf).withColumns({"current_level": F.lit(0), "change_version": F.lit(0).cast("bigint"), "last_reading": F.lit(None).cast("timestamp_ntz"), "last_pickup": F.lit(None).cast("timestamp_ntz"), "deleted_at": F.lit(None).cast("timestamp_ntz")})
    states = ingest.initial_states(empty)
    for rows in (r.where(F.col("id") <= half), r.where(F.col("id") > half)):
        flagged = arrivals.accepted_readings(rows, states=states.select("container_id", "current_level", "last_reading"))
        states = ingest.merge_states(states, flagged.where("accepted"))
    return states


@query("s01_ingested_states", with_ctes("readings", f"{_FINAL}, true AS available FROM readings GROUP BY container_id"))
def _s01(spark, sf):
    return _ingested(spark, sf).select("container_id", F.col("current_level").cast("int").alias("current_level"), "last_reading", "available")


@query(
    "s02_late_readings",
    with_ctes(
        "readings",
        "SELECT container_id, count(*) AS stored, count(*) FILTER (b IS NOT NULL AND reading_date <= b) AS late FROM (SELECT *, max(reading_date) OVER (PARTITION BY container_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM readings) GROUP BY container_id",
    ),
)
def _s02(spark, sf):
    """Late readings are stored and change no state."""
    flagged = arrivals.accepted_readings(a.readings(spark, sf))
    return flagged.groupBy("container_id").agg(F.count("*").alias("stored"), F.count_if(~F.col("accepted")).alias("late"))


@query("s09_reset_states", with_ctes("readings", "SELECT DISTINCT container_id, container_id // 3 AS site_id, 0 AS current_level, CAST(NULL AS TIMESTAMP) AS last_reading FROM readings"))
def _s09(spark, sf):
    return ingest.reset_states(_ingested(spark, sf)).select("container_id", "site_id", "current_level", "last_reading")
