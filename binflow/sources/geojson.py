"""GeoJSON features: container seeds and streets.

A FeatureCollection is one JSON document, so one file is one task; give large layers as
newline-delimited features (`lines=True`), which split like any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binflow.functions import text
from binflow.operators.filters import container_type_name


def _features(spark: SparkSession, path: str, feature: str, lines: bool) -> DataFrame:
    """One row per feature with its file and position."""
    if lines:
        wrapped = T.StructType.fromDDL(feature)
        rows = spark.read.schema(wrapped).json(path)
        return rows.select(F.struct("*").alias("f"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("position"))
    raw = spark.read.option("multiLine", True).schema(f"features array<struct<{feature}>>").json(path)
    return raw.select(F.input_file_name().alias("file"), F.posexplode("features").alias("position", "f"))


_CONTAINER = (
    "id: string, properties: struct<Id: string, CodEquipa: string, DireccionNormalizada: string, Descripcion: string,"
    " site_id: string, id_sitio: string, site_name: string>, geometry: struct<type: string, coordinates: array<double>>"
)
_STREET = (
    "properties: struct<nomoficial: string, nom_mapa: string, sentido: string, tipo_c: string, alt_izqini: string, alt_izqfin: string,"
    " alt_derini: string, alt_derfin: string>, geometry: struct<type: string, coordinates: string>"
)


def container_features(spark: SparkSession, path: str, prefix: str, label: str, known: DataFrame | None = None, lines: bool = False) -> DataFrame:
    """Seed containers with a `status` each: success, no_id, duplicate or bad_geom.

    Ids come from the properties, else from the feature; a repeated id keeps its first
    feature, also against `known` (serie_id).
    """
    rows = _features(spark, path, _CONTAINER, lines)
    raw = F.coalesce(F.nullif("f.properties.Id", F.lit("")), F.nullif("f.id", F.lit("")))
    rows = rows.withColumn("raw_id", raw).withColumn("serie_id", text.source_serie_id(F.col("raw_id"), prefix))
    first = Window.partitionBy("serie_id").orderBy("file", "position")
    rows = rows.withColumn("nth", F.when(F.col("serie_id").isNotNull(), F.row_number().over(first)))
    seen = F.lit(False)
    if known is not None:
        rows = rows.join(known.select("serie_id").distinct().withColumn("known", F.lit(True)), "serie_id", "left")
        seen = F.coalesce("known", F.lit(False))
    point = F.col("f.geometry.coordinates")
    status = (
        F.when(F.col("raw_id").isNull(), "no_id")
        .when(seen | (F.col("nth") > 1), "duplicate")
        .when(F.coalesce(F.size(point), F.lit(0)) < 2, "bad_geom")
        .otherwise("success")
    )
    code = F.upper(F.coalesce("f.properties.CodEquipa", F.lit("")))
    name = F.element_at(F.split("file", "/"), -1)
    return rows.select(
        "serie_id",
        F.col("f.properties.DireccionNormalizada").alias("address"),
        F.coalesce(F.nullif("f.properties.Descripcion", F.lit("")), F.concat(F.lit(f"Contenedor RSU {label} "), code)).alias("description"),
        F.get(point, F.lit(1)).alias("latitude"),
        F.get(point, F.lit(0)).alias("longitude"),
        container_type_name(name, code).alias("container_type"),
        F.coalesce("f.properties.site_id", "f.properties.id_sitio").alias("site_ref"),
        F.coalesce("f.properties.site_name", F.concat(F.lit("Sitio "), F.coalesce("f.properties.site_id", "f.properties.id_sitio"))).alias("site_name"),
        status.alias("status"),
    )


def import_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("status").agg(F.count("*").alias("features"))


def street_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """LineString streets: names upper-cased and trimmed, direction DOBLE by default. street_id is
    a hash of the file's path and the place in it: the same for every read, and distinct across
    files."""
    rows = _features(spark, path, _STREET, lines)

    def clean(*options: str | Column) -> Column:
        return F.trim(F.upper(F.coalesce(*[F.nullif(o, F.lit("")) if isinstance(o, str) else o for o in options])))

    p = "f.properties."
    points = F.transform(
        F.from_json("f.geometry.coordinates", "array<array<double>>"), lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    )
    return (
        rows.where(F.col("f.geometry.type") == "LineString")
        .select(
            F.xxhash64("file", "position").alias("street_id"),
            clean(p + "nomoficial", p + "nom_mapa", F.lit("")).alias("name"),
            clean(p + "sentido", F.lit("DOBLE")).alias("direction"),
            clean(p + "tipo_c", F.lit("")).alias("street_type"),
            F.col(p + "nomoficial").alias("nomoficial"), F.col(p + "nom_mapa").alias("nom_mapa"),
            *[F.col(p + c).alias(c) for c in ("alt_izqini", "alt_izqfin", "alt_derini", "alt_derfin")],
            points.alias("line"),
        )
        .where(F.size("line") >= 2)
    )
