"""Domain tables derived from the benchmark tables.

`events` rows are level readings of one container per user; suppliers are sites.
Half of the suppliers have no container, a few rows are soft deleted and a few
have no waste type, so outer joins and null rules are exercised. `lineitem` gives
a second, longer reading history keyed by supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.session import use_utc


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("container_id"),
        F.expr("user_id div 3").alias("site_id"),
        F.col("ts").alias("reading_date"),
        F.least(F.floor("value"), F.lit(100)).cast("int").alias("level"),
        (F.col("event_type") == "purchase").alias("collected"),
    )


def long_readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        (F.col("l_suppkey") * 3 + F.col("l_linenumber") % 3).alias("container_id"),
        F.col("l_suppkey").alias("site_id"),
        F.col("l_shipdate").alias("reading_date"),
        (F.col("l_quantity") * 2).cast("int").alias("level"),
        (F.col("l_returnflag") == "R").alias("collected"),
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Readings in the shape of the series operators."""
    return readings(spark, sf).select(
        "id",
        "site_id",
        "container_id",
        F.col("reading_date").alias("timestamp"),
        F.col("level").cast("double").alias("level"),
        "collected",
    )


def sites(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("id"),
        F.concat(F.lit("Sitio RSU - "), F.col("s_name")).alias("name"),
        F.expr("concat('AV. LINEA ', chr(65 + s_suppkey div 10 % 26), chr(65 + s_suppkey div 260 % 26), ' ', 100 + s_suppkey % 10)").alias("address"),
        (F.lit(-34.70) + (k % 25) * F.lit(0.004)).alias("latitude"),
        (F.lit(-58.53) + F.expr("s_suppkey div 25") * F.lit(0.005)).alias("longitude"),
        F.when(k % 3 == 0, "IZQUIERDA").when(k % 3 == 1, "DERECHA").otherwise("BILATERAL").alias("load_side_category"),
        F.when(k % 23 == 22, None).when(k % 4 == 3, 2).otherwise(1).cast("bigint").alias("waste_type_id"),
        (1 + k % 4).alias("container_type_id"),
        F.col("s_nationkey").cast("bigint").alias("neighborhood_id"),
        F.when(k % 41 == 40, F.expr("timestamp_ntz'2024-01-20 00:00:00'")).alias("deleted_at"),
    )


def containers(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf)
    newest = r.groupBy("container_id").agg(
        F.max_by("level", F.struct("reading_date", "id")).alias("current_level"),
        F.max("id").alias("change_version"),
        F.max("reading_date").alias("last_reading"),
        F.max(F.when(F.col("collected"), F.col("reading_date"))).alias("last_pickup"),
    )
    k = F.col("container_id")
    site = F.expr("container_id div 3")
    return newest.select(
        k.alias("id"),
        site.alias("site_id"),
        F.concat(F.lit("red|"), 5000 + k).alias("serie_id"),
        F.concat(F.lit("imei-"), k).alias("device_imei"),
        F.expr("concat('LINEA ', chr(65 + container_id div 30 % 26), ' ', 100 + container_id div 3)").alias("address"),
        (F.lit(-34.70) + (site % 25) * F.lit(0.004) + (k % 3) * F.lit(0.0001)).alias("latitude"),
        (F.lit(-58.53) + F.expr("container_id div 3 div 25") * F.lit(0.005) + (k % 2) * F.lit(0.0001)).alias("longitude"),
        "current_level",
        "change_version",
        (k % 7 != 0).alias("available"),
        "last_pickup",
        "last_reading",
        (1 + site % 4).alias("container_type_id"),
        (k % 25).alias("neighborhood_id"),
        F.when(k % 29 == 11, F.expr("timestamp_ntz'2024-01-25 00:00:00'")).alias("deleted_at"),
    )


def container_types(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES (1L, 'Lateral Fracción Húmeda', 150, 3.2D), (2L, 'Bilateral Fracción Húmeda', 160, 4.0D),"
        " (3L, 'Soterrado Fracción Húmeda', 200, 5.0D), (4L, 'Lateral Fracción Seca', 150, 3.2D) AS t(id, name, height_cm, volume_m3)"
    )


def waste_types(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES (1L, 'Fracción Húmeda', '#333333'), (2L, 'Fracción Seca', '#00aa00') AS t(id, name, color)"
    )


def type_waste_links(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (1L, 1L), (2L, 1L), (3L, 1L), (4L, 2L) AS t(container_type_id, waste_type_id)")


def neighborhoods(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("bigint").alias("commune"),
        (F.lit(1000) * (1 + F.col("n_nationkey") % 9)).cast("bigint").alias("population"),
        (F.lit(0.5) + F.col("n_nationkey") % 4).cast("double").alias("area_km2"),
    )
