"""Planar and spherical geometry as Column expressions.

Points are (x, y) columns, lines `array<struct<x,y>>`, polygons
`array<array<struct<x,y>>>` (rings). Everything stays inside code generation or
JVM higher-order functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius for great circles, metres per degree of the two
# flat-earth approximations, lower bound of the longitude scale.
EARTH_RADIUS_KM = 6371.0
STREET_METRES_PER_DEGREE = 111000.0
CLUSTER_METRES_PER_DEGREE = 111320.0
MIN_LONGITUDE_SCALE = 0.01


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_dlat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2.0)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def street_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat-earth metres, longitude scaled at the mid latitude of the pair."""
    dy = (lat2 - lat1) * STREET_METRES_PER_DEGREE
    dx = (lon2 - lon1) * STREET_METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2.0))
    return F.hypot(dy, dx)


def metres_per_degree(mean_lat: Column) -> tuple[Column, Column]:
    """(per degree of latitude, per degree of longitude) around a mean latitude."""
    scale = F.greatest(F.lit(MIN_LONGITUDE_SCALE), F.cos(F.radians(mean_lat)))
    return F.lit(CLUSTER_METRES_PER_DEGREE), F.lit(CLUSTER_METRES_PER_DEGREE) * scale


def planar_km(lat: Column, lon: Column, mean_lat: Column) -> tuple[Column, Column]:
    """Equirectangular kilometres around a reference latitude (degrees)."""
    return (
        F.lit(EARTH_RADIUS_KM) * F.radians(lon) * F.cos(F.radians(mean_lat)),
        F.lit(EARTH_RADIUS_KM) * F.radians(lat),
    )


@dataclass(frozen=True)
class TransverseMercator:
    """Projection parameters on the WGS84/GRS80 ellipsoid."""

    central_lon: float
    origin_lat: float
    scale: float
    false_easting: float
    false_northing: float


# EPSG:32721 (UTM 21 south) and EPSG:5347 (POSGAR 2007 belt 5).
UTM_21_SOUTH = TransverseMercator(-57.0, 0.0, 0.9996, 500_000.0, 10_000_000.0)
POSGAR_BELT_5 = TransverseMercator(-60.0, -90.0, 1.0, 5_500_000.0, 0.0)
_SEMI_MAJOR = 6378137.0
_FLATTENING = 1 / 298.257223563


def project(lat: Column, lon: Column, crs: TransverseMercator) -> tuple[Column, Column]:
    """(easting, northing) metres by the Kruger series of order four."""
    n = _FLATTENING / (2 - _FLATTENING)
    radius = _SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * crs.scale
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    sin_lat = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_lat) - F.lit(e) * F.atanh(F.lit(e) * sin_lat))
    dlon = F.radians(lon - F.lit(crs.central_lon))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    # Only origins on the equator or at the south pole occur; the rectifying
    # latitude of both is the latitude itself.
    origin = math.radians(crs.origin_lat)
    return (
        F.lit(crs.false_easting) + F.lit(radius) * east,
        F.lit(crs.false_northing) + F.lit(radius) * (north - F.lit(origin)),
    )


def project_line(line: Column, crs: TransverseMercator) -> Column:
    """Reproject a lon/lat line (x = lon, y = lat) to metres."""

    def one(point: Column) -> Column:
        x, y = project(point["y"], point["x"], crs)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(line, one)


def segment_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Position in [0, 1] of the point's projection on segment a-b."""
    dx, dy = bx - ax, by - ay
    length_sq = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / length_sq
    return F.when(length_sq == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = segment_fraction(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def legs(line: Column) -> Column:
    """Consecutive point pairs of a line: array<struct<a, b>>."""
    count = F.size(line) - 1
    return F.zip_with(
        F.slice(line, F.lit(1), count),
        F.slice(line, F.lit(2), count),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def line_length(line: Column) -> Column:
    return F.aggregate(
        legs(line),
        F.lit(0.0),
        lambda total, leg: total + F.hypot(leg["b"]["x"] - leg["a"]["x"], leg["b"]["y"] - leg["a"]["y"]),
    )


def line_distance(px: Column, py: Column, line: Column) -> Column:
    return F.array_min(
        F.transform(
            legs(line),
            lambda leg: segment_distance(px, py, leg["a"]["x"], leg["a"]["y"], leg["b"]["x"], leg["b"]["y"]),
        )
    )


def project_on_line(px: Column, py: Column, line: Column) -> Column:
    """Distance along the line to the point's nearest position (first leg on ties)."""

    def step(acc: Column, leg: Column) -> Column:
        ax, ay, bx, by = leg["a"]["x"], leg["a"]["y"], leg["b"]["x"], leg["b"]["y"]
        length = F.hypot(bx - ax, by - ay)
        distance = segment_distance(px, py, ax, ay, bx, by)
        along = acc["walked"] + segment_fraction(px, py, ax, ay, bx, by) * length
        closer = distance < acc["best"]
        return F.struct(
            (acc["walked"] + length).alias("walked"),
            F.when(closer, distance).otherwise(acc["best"]).alias("best"),
            F.when(closer, along).otherwise(acc["at"]).alias("at"),
        )

    start = F.struct(
        F.lit(0.0).alias("walked"), F.lit(float("inf")).alias("best"), F.lit(0.0).alias("at")
    )
    return F.aggregate(legs(line), start, step, lambda acc: acc["at"])


def interpolate(line: Column, fraction: Column) -> Column:
    """Point at a fraction of the line's length: struct<x, y>."""
    target = fraction * line_length(line)

    def step(acc: Column, leg: Column) -> Column:
        ax, ay, bx, by = leg["a"]["x"], leg["a"]["y"], leg["b"]["x"], leg["b"]["y"]
        length = F.hypot(bx - ax, by - ay)
        inside = (~acc["done"]) & (acc["walked"] + length >= target)
        t = F.when(length > 0, (target - acc["walked"]) / length).otherwise(F.lit(0.0))
        return F.struct(
            (acc["walked"] + length).alias("walked"),
            (acc["done"] | inside).alias("done"),
            F.when(inside, ax + t * (bx - ax)).otherwise(F.when(acc["done"], acc["x"]).otherwise(bx)).alias("x"),
            F.when(inside, ay + t * (by - ay)).otherwise(F.when(acc["done"], acc["y"]).otherwise(by)).alias("y"),
        )

    start = F.struct(
        F.lit(0.0).alias("walked"),
        F.lit(False).alias("done"),
        line[0]["x"].alias("x"),
        line[0]["y"].alias("y"),
    )
    return F.aggregate(legs(line), start, step, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y")))


def ring_crossings(px: Column, py: Column, ring: Column) -> Column:
    """Edges of a closed ring crossed by the ray to the right; half-open in y, so a
    shared edge belongs to exactly one of two neighbouring polygons."""

    def crosses(leg: Column) -> Column:
        ax, ay, bx, by = leg["a"]["x"], leg["a"]["y"], leg["b"]["x"], leg["b"]["y"]
        spans = (ay > py) != (by > py)
        return F.when(spans & (px < (bx - ax) * (py - ay) / (by - ay) + ax), 1).otherwise(0)

    return F.aggregate(F.transform(legs(ring), crosses), F.lit(0), lambda n, c: n + c)


def in_polygon(px: Column, py: Column, rings: Column) -> Column:
    total = F.aggregate(
        F.transform(rings, lambda ring: ring_crossings(px, py, ring)), F.lit(0), lambda n, c: n + c
    )
    return total % 2 == 1


def polygon_distance(px: Column, py: Column, rings: Column) -> Column:
    """Zero inside, else the distance to the nearest edge."""
    edge = F.array_min(F.transform(rings, lambda ring: line_distance(px, py, ring)))
    return F.when(in_polygon(px, py, rings), F.lit(0.0)).otherwise(edge)


def bounds(points: Column) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y) of a line or ring."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def spherical_area_km2(ring: Column) -> Column:
    """Area of a lon/lat ring on the authalic sphere."""
    authalic_radius_km = 6371.0072

    def leg_term(leg: Column) -> Column:
        dlon = F.radians(leg["b"]["x"] - leg["a"]["x"])
        return dlon * (2 + F.sin(F.radians(leg["a"]["y"])) + F.sin(F.radians(leg["b"]["y"])))

    total = F.aggregate(F.transform(legs(ring), leg_term), F.lit(0.0), lambda s, v: s + v)
    return F.abs(total) * F.lit(authalic_radius_km**2 / 2)


def cell(value: Column, size: Column | float) -> Column:
    width = size if isinstance(size, Column) else F.lit(float(size))
    return F.floor(value / width).cast("bigint")


_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def points_from_text(text: Column) -> Column:
    """The coordinate pairs of a WKT body, in order: array<struct<x, y>>."""
    pairs = F.regexp_extract_all(text, F.lit(rf"({_NUMBER}\s+{_NUMBER})"), F.lit(1))

    def pair(p: Column) -> Column:
        parts = F.split(p, r"\s+")
        return F.struct(parts[0].cast("double").alias("x"), parts[1].cast("double").alias("y"))

    return F.transform(pairs, pair)


def line_from_wkt(text: Column) -> Column:
    """First line of a LINESTRING or MULTILINESTRING; null when not a line."""
    body = F.regexp_extract(text, r"(?i)^\s*(?:MULTI)?LINESTRING\s*Z?\s*\(+([^()]*)\)", 1)
    points = points_from_text(body)
    return F.when(F.size(points) >= 2, points)


def polygon_from_wkt(text: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON; null when not a polygon. All rings go in
    one list: parity then treats holes and parts alike."""
    is_polygon = F.regexp_like(text, F.lit(r"(?i)^\s*(?:MULTI)?POLYGON\s*Z?\s*\("))
    bodies = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    rings = F.filter(F.transform(bodies, points_from_text), lambda ring: F.size(ring) >= 4)
    return F.when(is_polygon & (F.size(rings) > 0), rings)
