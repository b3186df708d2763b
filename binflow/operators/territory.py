"""Territory joins: polygons, streets, curb segments, addresses, routes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from binflow.functions import geo, text
from binflow.functions.numbers import half_even
from binflow.operators import spatial
from binflow.session import attach, cut

# Metres within which a segment is considered, and within which the most
# favourable one counts; segment lengths reported.
CAPACITY_RADIUS_M, CORNER_RADIUS_M = 35.0, 25.0
MIN_LENGTH_M, MAX_LENGTH_M = 5.0, 400.0
# Opposing sites differ at most this much in number and in metres.
OPPOSING_NUMBERS, OPPOSING_METRES = 60, 60.0
ROUTE_SLACK = 50
#: House numbers have one to five digits.
NUMBER_BITS = 17


def _polygon_box(rings: Column) -> tuple[Column, Column, Column, Column]:
    return geo.bounds(F.flatten(rings))


def locate(points: DataFrame, polygons: DataFrame, cell: float, point_key: str = "id") -> DataFrame:
    """(point, polygon_id) of the polygon holding each point, lowest id when several do.

    Points: key, x, y; polygons: polygon_id, rings. Polygons meet points on the cells of
    their bounding box; choose the cell near the usual polygon size.
    """
    laid = spatial.on_box_cells(polygons.select("polygon_id", "rings"), _polygon_box(F.col("rings")), cell)
    at = spatial.on_cells(points.select(point_key, "x", "y"), F.col("x"), F.col("y"), cell)
    inside = at.join(laid, list(spatial.CELLS)).where(geo.in_polygon(F.col("x"), F.col("y"), F.col("rings")))
    return inside.groupBy(point_key).agg(F.min("polygon_id").alias("polygon_id"))


def locate_or_nearest(points: DataFrame, polygons: DataFrame, cell: float, point_key: str = "id") -> DataFrame:
    """Like `locate`, and the closest polygon for points outside all."""
    inside = locate(points, polygons, cell, point_key)
    outside = points.select(point_key, "x", "y").join(inside.select(point_key), point_key, "left_anti")
    edge = F.array_min(F.transform("rings", lambda ring: geo.line_distance(F.col("_px"), F.col("_py"), ring)))
    near = spatial.nearest(
        outside, polygons.select("polygon_id", "rings"), point_key, (F.col("x"), F.col("y")), _polygon_box(F.col("rings")), edge, cell, ("polygon_id",)
    )
    return inside.unionByName(near.select(point_key, "polygon_id"))


def spatial_metadata(containers: DataFrame, layers: dict[str, tuple[DataFrame, float, bool]]) -> DataFrame:
    """One column `{layer}_id` per polygon layer; the flag asks for the nearest polygon
    when a container lies in none."""
    points = containers.select(F.col("id").alias("container_id"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    out = points.select("container_id")
    for name, (polygons, cell, fall_back) in layers.items():
        find = locate_or_nearest if fall_back else locate
        hits = find(points, polygons, cell, "container_id").withColumnRenamed("polygon_id", f"{name}_id")
        out = out.join(hits, "container_id", "left")
    return out


def street_legs(streets: DataFrame) -> DataFrame:
    """Sub-segments of the streets: street_id, leg, end points, and the street's facts."""
    return streets.select(
        "street_id", "name", "direction", "street_type", F.posexplode(geo.legs(F.col("line"))).alias("leg", "p")
    ).select(
        "street_id", "name", "direction", "street_type", "leg",
        F.col("p.a.x").alias("ax"), F.col("p.a.y").alias("ay"), F.col("p.b.x").alias("bx"), F.col("p.b.y").alias("by"),
    )


def _leg_box() -> tuple[Column, Column, Column, Column]:
    return F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by")


def nearest_street(points: DataFrame, streets: DataFrame, start: float, point_key: str = "id") -> DataFrame:
    """Closest street of each point and the side of travel it lies on."""
    distance = geo.segment_distance(F.col("_px"), F.col("_py"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    hit = spatial.nearest(
        points, street_legs(streets), point_key, (F.col("x"), F.col("y")), _leg_box(), distance, start, ("street_id", "leg")
    )
    placed = hit.join(points.select(point_key, "x", "y"), point_key)
    cross = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax"))
    left = cross > 0
    side = (
        F.when(F.col("direction") == "DOBLE", "BILATERAL")
        .when(F.col("direction") == "DECRECIENTE", F.when(left, "DERECHA").otherwise("IZQUIERDA"))
        .otherwise(F.when(left, "IZQUIERDA").otherwise("DERECHA"))
    )
    upper = F.upper("name")
    avenue = (F.upper("street_type") == "AVENIDA") | F.contains(upper, F.lit("AV.")) | F.contains(upper, F.lit("AVENIDA"))
    known = F.col("street_id").isNotNull()
    return placed.select(point_key, "street_id", "distance", F.when(known, side).alias("load_side"), F.when(known, avenue).alias("is_avenue"))


def segment_capacity(sites: DataFrame, segments: DataFrame, key: str = "site_id") -> DataFrame:
    """Capacity and length of the segment that rules each site (within 35 m): the most
    favourable within 25 m, else the nearest. Sites without a segment are absent.

    Sites: key, latitude, longitude; segments: segment_id, capacity, line (lon/lat).
    Locations repeat, so distances run once per distinct coordinate.
    """
    spots = sites.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("latitude", "longitude").distinct()
    east, north = geo.project(F.col("latitude"), F.col("longitude"), geo.UTM_21_SOUTH)
    at = spatial.on_cells(spots.withColumn("x", east).withColumn("y", north), F.col("x"), F.col("y"), 2 * CAPACITY_RADIUS_M)
    lines = segments.select("segment_id", "capacity", geo.project_line(F.col("line"), geo.UTM_21_SOUTH).alias("line"))
    laid = spatial.on_box_cells(lines, geo.bounds(F.col("line")), 2 * CAPACITY_RADIUS_M, margin=CAPACITY_RADIUS_M)
    near = (
        at.join(laid, list(spatial.CELLS))
        .withColumn("distance", geo.line_distance(F.col("x"), F.col("y"), F.col("line")))
        .where(F.col("distance") <= CAPACITY_RADIUS_M)
        .withColumn("length", geo.line_length(F.col("line")))
    )
    corner = F.col("distance") <= CORNER_RADIUS_M
    ruled = near.groupBy("latitude", "longitude").agg(
        F.max_by(
            F.struct("segment_id", "capacity", "length"),
            F.struct(F.when(corner, F.col("capacity")).alias("c"), F.when(~corner, -F.col("distance")).alias("d"), (-F.col("segment_id")).alias("s")),
        ).alias("g"),
        F.max(corner.cast("int")).alias("has_corner"),
    )
    # Nulls sort lowest, so a corner candidate always beats one that is only near.
    return sites.select(key, "latitude", "longitude").join(ruled, ["latitude", "longitude"]).select(
        key, "g.segment_id", F.col("g.capacity").alias("segment_capacity"), F.col("g.length").alias("length_m")
    )


def capacity_verdict(sites: DataFrame, ruled: DataFrame | None, key: str = "site_id") -> DataFrame:
    """Most containers a site may hold, free slots and whether one more may enter.

    `sites` has the key, coordinates and `containers`. Without any segment data nothing is
    limited; without coordinates or a close segment the site stays as it is.
    """
    now = F.greatest(F.lit(1), F.col("containers"))
    if ruled is None:
        return sites.select(key, F.lit(None).cast("int").alias("max_containers"), F.lit(True).alias("may_enter"))
    rows = sites.join(ruled, key, "left")
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    capacity = F.col("segment_capacity")
    blocked = capacity.isNull() | (capacity <= 0)
    limit = F.when(~placed, None).when(blocked, now).otherwise(F.greatest(F.lit(1), capacity))
    return rows.select(
        key,
        limit.cast("int").alias("max_containers"),
        (placed & ~blocked & (F.greatest(F.lit(1), capacity) > F.col("containers"))).alias("may_enter"),
        F.when(blocked, F.lit(0)).otherwise(F.greatest(F.lit(0), F.greatest(F.lit(1), capacity) - F.col("containers"))).cast("int").alias("free_slots"),
        F.coalesce(F.greatest(F.lit(MIN_LENGTH_M), F.least(F.lit(MAX_LENGTH_M), half_even(F.col("length_m"), 2))), F.lit(MIN_LENGTH_M)).alias("_length"),
        F.when(capacity.isNull(), "SIN_TRAMO_CERCANO").alias("status"),
        capacity.isNotNull().alias("_known"),
    ).withColumn("length_m", F.when(F.col("_known"), F.col("_length")).otherwise(F.lit(0.0))).drop("_length", "_known")


def buffered_links(tracts: DataFrame, containers: DataFrame, buffer_m: float = 18.0) -> DataFrame:
    """(radio_code, container_id, weight) for containers within the buffer of a tract; the
    weight falls linearly from the tract's edge. Distances in projected metres."""
    def ring_m(ring: Column) -> Column:
        return geo.project_line(ring, geo.POSGAR_BELT_5)

    metric = tracts.select("radio_code", F.transform("rings", ring_m).alias("rings"))
    size = max(100.0, 4 * buffer_m)
    laid = spatial.on_box_cells(metric, _polygon_box(F.col("rings")), size, margin=buffer_m)
    east, north = geo.project(F.col("latitude"), F.col("longitude"), geo.POSGAR_BELT_5)
    at = spatial.on_cells(
        containers.select(F.col("id").alias("container_id"), east.alias("x"), north.alias("y")), F.col("x"), F.col("y"), size
    )
    return (
        at.join(laid, list(spatial.CELLS))
        .withColumn("distance", geo.polygon_distance(F.col("x"), F.col("y"), F.col("rings")))
        .where(F.col("distance") <= buffer_m)
        .select("radio_code", "container_id", F.greatest(F.lit(0.0), F.lit(buffer_m) - F.col("distance")).alias("weight"))
    )


def _edges(rings: Column, base: Column) -> Column:
    """The non-vertical edges of all rings as heights over `base`, left to right, with the sign
    of their direction; a ring is closed if it isn't yet."""
    def of(ring: Column) -> Column:
        closed = F.concat(ring, F.slice(ring, 1, 1))
        pairs = F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(F.get(closed, i).alias("a"), F.get(closed, i + 1).alias("b")))
        return F.transform(F.filter(pairs, lambda p: p.a.x != p.b.x), lambda p: F.struct(
            F.least(p.a.x, p.b.x).alias("l"), F.greatest(p.a.x, p.b.x).alias("r"),
            (F.when(p.a.x < p.b.x, p.a.y).otherwise(p.b.y) - base).alias("u"), (F.when(p.a.x < p.b.x, p.b.y).otherwise(p.a.y) - base).alias("v"),
            F.when(p.a.x < p.b.x, 1.0).otherwise(-1.0).alias("sign"),
        ))

    return F.flatten(F.transform(rings, of))


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two edge lists over one base (`_edges`) share.

    A polygon is the signed sum of the strips below its edges, so the shared area is the signed
    sum, over pairs of edges, of the integral of the lower one where both run.
    """
    def strip(p: Column, q: Column) -> Column:
        lo, hi = F.greatest(p.l, q.l), F.least(p.r, q.r)

        def at(e: Column, x: Column) -> Column:
            return e.u + (e.v - e.u) * (x - e.l) / (e.r - e.l)

        left, right = at(p, lo) - at(q, lo), at(p, hi) - at(q, hi)
        # The lower line is q plus the negative part of p - q, a triangle or a trapezoid.
        below = (
            F.when((left < 0) & (right > 0), left * (left / (left - right)) / 2)
            .when((left > 0) & (right < 0), right * (right / (right - left)) / 2)
            .otherwise((F.least(left, F.lit(0.0)) + F.least(right, F.lit(0.0))) / 2)
        )
        return F.when(lo < hi, p.sign * q.sign * (hi - lo) * ((at(q, lo) + at(q, hi)) / 2 + below)).otherwise(0.0)

    return F.abs(F.aggregate(a, F.lit(0.0), lambda s, p: s + F.aggregate(b, F.lit(0.0), lambda t, q: t + strip(p, q))))


def largest_overlap(tracts: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(radio_code, polygon_id) of the polygon covering most of each tract, by exact area; of
    equal areas the lowest id. Tracts that no polygon overlaps are left out.

    Rings run one way for shells and the other for holes, or all rings of a polygon are shells.
    Only boxes are laid on cells; rings join once for each pair whose boxes meet.
    """
    def boxed(df: DataFrame, key: str) -> DataFrame:
        x0, y0, x1, y1 = _polygon_box(F.col("rings"))
        return df.select(key, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    box = (F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    t = spatial.on_box_cells(boxed(tracts, "radio_code"), box, cell)
    p = spatial.on_box_cells(boxed(polygons, "polygon_id"), box, cell).withColumnsRenamed({c: f"p{c}" for c in ("x0", "y0", "x1", "y1")})
    meet = (F.col("x0") < F.col("px1")) & (F.col("px0") < F.col("x1")) & (F.col("y0") < F.col("py1")) & (F.col("py0") < F.col("y1"))
    pairs = t.join(p, list(spatial.CELLS)).where(meet).select("radio_code", "polygon_id", F.least("y0", "py0").alias("base")).distinct()
    both = pairs.join(tracts.select("radio_code", F.col("rings").alias("_t")), "radio_code").join(polygons.select("polygon_id", F.col("rings").alias("_p")), "polygon_id")
    area = overlap_area(_edges(F.col("_t"), F.col("base")), _edges(F.col("_p"), F.col("base")))
    # Areas are compared to six digits of the tract's, so rounding breaks no tie; what is less than
    # that counts still, down to the noise of the sums.
    covered = both.select("radio_code", "polygon_id", (area / overlap_area(_edges(F.col("_t"), F.col("base")), _edges(F.col("_t"), F.col("base")))).alias("share"))
    covered = covered.where(F.col("share") > 1e-12).select("*", F.round("share", 6).alias("digits"), F.round("share", 12).alias("rest"))
    order = F.struct("digits", F.when(F.col("digits") == 0, F.col("rest")).otherwise(0.0), -F.col("polygon_id"))
    return covered.groupBy("radio_code").agg(F.max_by("polygon_id", order).alias("polygon_id"))


def street_ranges(streets: DataFrame) -> DataFrame:
    """Street segments with their number range and every key they can be found by.

    Input: seq, nomoficial, nom_mapa, alt_izqini, alt_izqfin, alt_derini, alt_derfin, line.
    Output: kind (name or words), key, seq, low, high, line.
    """
    ends = [F.coalesce(F.col(c).cast("double").cast("int"), F.lit(0)) for c in ("alt_izqini", "alt_izqfin", "alt_derini", "alt_derfin")]
    used = F.filter(F.array(*ends), lambda v: v > 0)
    official, on_map = F.coalesce("nomoficial", F.lit("")), F.coalesce("nom_mapa", F.lit(""))
    parts = F.split(official, ",")
    both_orders = F.when(
        F.size(parts) == 2,
        F.array(text.normal_name(F.concat_ws(" ", parts[1], parts[0])), text.normal_name(F.concat_ws(" ", parts[0], parts[1]))),
    ).otherwise(F.array().cast("array<string>"))
    names = F.array_distinct(F.concat(F.array(text.normal_name(official), text.normal_name(on_map)), both_orders))
    words = F.array(text.significant_words(official), text.significant_words(on_map))
    joined = F.transform(words, lambda w: F.array_join(w, " "))
    long_words = F.flatten(
        F.transform(words, lambda w: F.when(F.size(w) >= 2, F.filter(w, lambda t: F.length(t) >= 4)).otherwise(F.array().cast("array<string>")))
    )
    keys = F.concat(
        F.transform(names, lambda n: F.struct(F.lit("name").alias("kind"), n.alias("key"))),
        F.transform(F.array_distinct(F.concat(joined, long_words)), lambda n: F.struct(F.lit("words").alias("kind"), n.alias("key"))),
    )
    return (
        streets.select(
            "seq", "line", F.coalesce(F.array_min(used), F.lit(0)).alias("low"), F.greatest(*ends).alias("high"), F.explode(keys).alias("k")
        )
        .select("k.kind", "k.key", "seq", "low", "high", "line")
        .where(F.col("key") != "")
    )


def geocode(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Point of each distinct (street, number): by whole name, else by significant words,
    else by the longest word; the first range holding the number, else the nearest end."""
    wanted = addresses.select("street", "number").distinct()
    words = text.significant_words(F.col("street"))
    longest = F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    keyed = wanted.select(
        "street", "number",
        text.normal_name(F.col("street")).alias("k0"),
        F.array_join(words, " ").alias("k1"),
        F.when(F.length(longest) >= 4, longest).alias("k2"),
    )
    rest, parts = keyed, []
    for tier, kind in (("k0", "name"), ("k1", "words"), ("k2", "words")):
        index = ranges.where(F.col("kind") == kind)
        known = rest.join(index.select("key").distinct(), rest[tier] == F.col("key"), "left_semi")
        parts.append(known.join(index, known[tier] == index["key"]).select("street", "number", "seq", "low", "high", "line"))
        rest = rest.join(known.select("street", "number"), ["street", "number"], "left_anti")
    candidates = parts[0].unionByName(parts[1]).unionByName(parts[2])
    inside = F.col("number").between(F.col("low"), F.col("high"))
    gap = F.least(F.abs(F.col("low") - F.col("number")), F.abs(F.col("high") - F.col("number")))
    order = F.struct((~inside).alias("outside"), F.when(inside, F.lit(0)).otherwise(gap).alias("gap"), "seq")
    best = candidates.groupBy("street", "number").agg(F.min_by(F.struct("low", "high", "line"), order).alias("b"))
    held = F.col("number").between(F.col("b.low"), F.col("b.high")) & (F.col("b.high") > F.col("b.low"))
    fraction = F.when(held, (F.col("number") - F.col("b.low")) / (F.col("b.high") - F.col("b.low"))).otherwise(F.lit(0.5))
    point = geo.interpolate(F.col("b.line"), fraction)
    return best.withColumn("p", point).select("street", "number", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


#: So many route centres are compared with each site at once; more are searched by cells.
FEW_CENTRES = 2000


def _away(lat: Column, lon: Column, clat: Column, clon: Column) -> Column:
    return F.hypot(lat - clat, (lon - clon) * F.cos(F.radians((lat + clat) / 2)))


def _nearest_of_few(sites: DataFrame, centres: DataFrame) -> DataFrame:
    """Workers pick the centres that may be nearest, with room for rounding; `_away` decides among them."""
    listed = centres.select("clat", "clon", "route_id")
    few = listed.collect()
    clat, clon = (np.array([np.nan if r[c] is None else r[c] for r in few], float) for c in ("clat", "clon"))

    @F.pandas_udf("array<int>")
    def candidates(lat: pd.Series, lon: pd.Series) -> pd.Series:
        found = []
        for i in range(0, len(lat) if len(clat) else 0, 1000):
            y, x = (v.iloc[i : i + 1000].to_numpy(float)[:, None] for v in (lat, lon))
            d = np.hypot(y - clat, (x - clon) * np.cos(np.radians((y + clat) / 2)))
            least = np.fmin.reduce(d, axis=1)[:, None]
            # Unknown distances are left to `_away`, too.
            row, centre = np.nonzero(~(d > least * (1 + 1e-9)))
            found += np.split(centre.astype(np.int32), np.searchsorted(row, np.arange(1, len(d))))
        return pd.Series(found if len(clat) else [[]] * len(lat), dtype=object)

    spark = sites.sparkSession
    row = spark.createDataFrame([(few,)], StructType([StructField("_centres", ArrayType(listed.schema))]))
    placed = sites.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    placed = placed.select("site_id", "latitude", "longitude", candidates(F.col("latitude").cast("double"), F.col("longitude").cast("double")).alias("_near"))

    def measured(i: Column) -> Column:
        q = F.get("_centres", i)
        return F.struct(_away(F.col("latitude"), F.col("longitude"), q["clat"], q["clon"]).alias("d"), q["route_id"].alias("route_id"))

    return attach(placed, row).select("site_id", F.array_min(F.transform("_near", measured))["route_id"].alias("route_id"))


def _nearest_centre(sites: DataFrame, centres: DataFrame, start_km: float) -> DataFrame:
    """Cells use longitudes shrunk by the cosine of the highest latitude present: a lower bound
    of the true east-west distance anywhere, so the ring search misses nothing."""
    tops = [df.agg(F.max(F.abs(F.col(c))).alias("top")).first().top for df, c in ((sites, "latitude"), (centres, "clat"))]
    shrink = max(1e-6, math.cos(math.radians(min(90.0, max([0.0, *(t for t in tops if t is not None)])))))
    narrow = F.col("clon") * shrink
    return spatial.nearest(
        sites, centres, "site_id", (F.col("longitude") * shrink, F.col("latitude")), (narrow, F.col("clat"), narrow, F.col("clat")),
        _away(F.col("_py"), F.col("_px") / shrink, F.col("clat"), F.col("clon")), start_km / 111.0, ("route_id",),
    )


def _blocks(low: Column, end: Column) -> Column:
    """The fewest aligned blocks, two of each level at most, that make up the numbers from `low` to before `end`."""
    found = []
    for level in range(NUMBER_BITS + 1):
        a, b = F.shiftright(low + (2**level - 1), level), F.shiftright(end, level)
        found += [
            F.when((a < b) & (a % 2 == 1), F.struct(F.lit(level).alias("level"), a.alias("block"))),
            F.when((a < b) & (b % 2 == 1), F.struct(F.lit(level).alias("level"), (b - 1).alias("block"))),
        ]
    return F.array_compact(F.array(*found))


def _first_holding(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """(street, number, h): the first segment of the street, by (route_rank, segment, route_id),
    that holds the number with the slack.

    Ranges are cut into aligned blocks, each of which keeps its first segment; a number asks the
    blocks around it. So no segment meets every number of a long street.
    """
    ranges = segments.groupBy("street", "low", "high").agg(F.min(F.struct("route_rank", "segment", "route_id")).alias("h"))
    low = F.ceil(F.greatest(F.col("low") - ROUTE_SLACK, F.lit(0))).cast("bigint")
    end = F.floor(F.least(F.col("high") + ROUTE_SLACK, F.lit(2**NUMBER_BITS - 1))).cast("bigint") + 1
    known = ranges.where(F.col("low").isNotNull()).select("street", "h", low.alias("from"), end.alias("end"))
    laid = known.select("street", "h", F.explode(_blocks(F.col("from"), F.col("end"))).alias("b"))
    firsts = laid.groupBy("street", "b.level", "b.block").agg(F.min("h").alias("h"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(NUMBER_BITS)))
    asking = asked.where("number IS NOT NULL").withColumn("level", levels).withColumn("block", F.expr("shiftright(cast(number AS bigint), level)"))
    return asking.join(firsts, ["street", "level", "block"]).groupBy("street", "number").agg(F.min("h").alias("h"))


def assign_routes(sites: DataFrame, segments: DataFrame, fallback_centres: DataFrame, start_km: float = 1.0) -> DataFrame:
    """Route and stop order of each site: the first segment of its street holding its
    number (with 50 of slack), else the street's first segment, else the route whose
    centre is nearest.

    Segments: route_id, route_rank (file order of the route), segment (index in the
    route), street_name, alt_start, alt_end. Fallback centres: route_id, latitude,
    longitude for routes that got no site by street.
    """
    address = text.parse_address(F.coalesce("address", "name"))
    # Parsing is most of the work: done once, by all tasks, however few files the rows come from.
    tasks = sites.sparkSession.sparkContext.defaultParallelism
    parsed = cut(sites.select("site_id", "latitude", "longitude", "address", "name").repartition(tasks).select("site_id", "latitude", "longitude", address.alias("a")))
    key = F.coalesce(text.street_name(F.col("street_name")), F.upper(F.trim("street_name")))
    s = segments.select("street_name", "route_id", "route_rank", "segment", "alt_start", "alt_end").repartition(tasks).select(
        key.alias("street"), "route_id", "route_rank", "segment",
        F.least("alt_start", "alt_end").alias("low"), F.greatest("alt_start", "alt_end").alias("high"),
    )
    s = cut(s)
    order = F.struct("route_rank", "segment")
    first = s.groupBy("street").agg(F.min_by(F.struct("route_id", "segment"), order).alias("f"))
    named = parsed.where(F.col("a").isNotNull()).select("site_id", F.col("a.street").alias("street"), F.col("a.number").alias("number"))
    held = named.join(_first_holding(s, named.select("street", "number").distinct()), ["street", "number"]).groupBy("site_id").agg(F.min("h").alias("h"))
    matched = cut(
        named.join(first, "street")
        .join(held, "site_id", "left")
        .select("site_id", F.coalesce("h.route_id", "f.route_id").alias("route_id"), F.coalesce("h.segment", "f.segment").cast("bigint").alias("stop_order"))
    )
    located = matched.join(parsed.select("site_id", "latitude", "longitude"), "site_id").where((F.col("latitude") != 0) | (F.col("longitude") != 0))
    centres = located.groupBy("route_id").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    centres = centres.unionByName(fallback_centres.join(centres.select("route_id"), "route_id", "left_anti").select("route_id", "latitude", "longitude"))
    rest = parsed.join(matched.select("site_id"), "site_id", "left_anti").where((F.col("latitude") != 0) | (F.col("longitude") != 0))
    # Routes with one centre, as all that got no site may have, are equally far: the lowest stands for them.
    c = centres.groupBy(F.col("latitude").alias("clat"), F.col("longitude").alias("clon")).agg(F.min(F.struct("route_id")).alias("r"))
    c = cut(c.select("r.route_id", "clat", "clon"))

    near = _nearest_of_few(rest, c) if c.limit(FEW_CENTRES + 1).count() <= FEW_CENTRES else _nearest_centre(rest, c, start_km)
    last = near.where(F.col("route_id").isNotNull()).select("site_id", "route_id", F.lit(10**9).cast("bigint").alias("stop_order"))
    return matched.unionByName(last)


def opposing_sites(sites: DataFrame, max_metres: float = OPPOSING_METRES, max_numbers: int = OPPOSING_NUMBERS) -> DataFrame:
    """(site_id, opposing_id) both ways: each even number takes its nearest odd across the
    street; an odd taken by several evens stays with the first.

    Evens meet odds on the street and a band of numbers, so a long street never pairs as a
    whole. `sites`: site_id, address, name, latitude, longitude.
    """
    address = F.coalesce(text.parse_address(F.col("address")), text.parse_address(F.col("name")))
    p = sites.select("site_id", "latitude", "longitude", address.alias("a")).where("a IS NOT NULL")
    p = p.select("site_id", "latitude", "longitude", F.col("a.street").alias("street"), F.col("a.number").alias("number"))
    band = F.floor(F.col("number") / max_numbers)
    evens = p.where(F.col("number") % 2 == 0).withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    odds = p.where(F.col("number") % 2 != 0).select(
        "street", band.alias("band"), F.col("site_id").alias("odd_id"), F.col("number").alias("odd_number"),
        F.col("latitude").alias("odd_lat"), F.col("longitude").alias("odd_lon"),
    )
    metres = geo.street_metres(F.col("latitude"), F.col("longitude"), F.col("odd_lat"), F.col("odd_lon"))
    best = (
        evens.join(odds, ["street", "band"])
        .where(F.abs(F.col("number") - F.col("odd_number")) <= max_numbers)
        .withColumn("metres", metres)
        .where(F.col("metres") <= max_metres)
        .groupBy("site_id")
        .agg(F.min_by("odd_id", F.struct("metres", "odd_id")).alias("odd_id"))
    )
    kept = best.groupBy("odd_id").agg(F.min("site_id").alias("site_id"))
    return kept.select("site_id", F.col("odd_id").alias("opposing_id")).unionByName(
        kept.select(F.col("odd_id").alias("site_id"), F.col("site_id").alias("opposing_id"))
    )


def dominant_territory(containers: DataFrame, metadata: DataFrame) -> DataFrame:
    """Territory holding most of each site's containers (lowest id on ties)."""
    counted = (
        containers.where(F.col("deleted_at").isNull() & F.col("site_id").isNotNull())
        .select("site_id", F.col("id").alias("container_id"))
        .join(metadata.select("container_id", "territory_id"), "container_id")
        .groupBy("site_id", "territory_id")
        .agg(F.count("*").alias("container_count"))
    )
    order = F.struct("container_count", -F.coalesce("territory_id", F.lit(-1)))
    return counted.groupBy("site_id").agg(
        F.max_by("territory_id", order).alias("territory_id"), F.max("container_count").alias("container_count")
    )


def site_features(dominant: DataFrame, territories: DataFrame) -> DataFrame:
    """Entity-attribute-value rows of each site's territory; missing facts give no row.

    Territories: territory_id, neighborhood, commune, population, density_per_km2,
    density_factor.
    """
    facts = dominant.join(territories, "territory_id", "left")

    def entry(key: str, number: Column | None, category: Column | None) -> Column:
        return F.struct(
            F.lit(key).alias("feature_key"),
            (F.lit(None) if number is None else number).cast("double").alias("numeric_value"),
            (F.lit(None) if category is None else category).cast("string").alias("category_value"),
        )

    # The feature keys.
    entries = F.array(
        entry("territory.neighborhood", None, F.col("neighborhood")),
        entry("territory.commune", F.col("commune"), F.col("commune").cast("string")),
        entry("demographics.population", F.col("population"), None),
        entry("demographics.density_per_km2", F.col("density_per_km2"), None),
        entry("demand.density_factor", F.col("density_factor"), None),
    )
    rows = facts.select("site_id", F.explode(entries).alias("f")).select("site_id", "f.*")
    return rows.where(F.col("numeric_value").isNotNull() | F.col("category_value").isNotNull())


def feature_map(features: DataFrame) -> DataFrame:
    """Features of each site collected as one map of (number, category)."""
    value = F.struct(F.col("numeric_value").alias("num"), F.col("category_value").alias("cat"))
    return features.groupBy("site_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_key", value.alias("v"))))).alias("features"))


def replace_source(existing: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """All features with those of one source replaced."""
    return existing.where(F.col("source") != source).unionByName(fresh.withColumn("source", F.lit(source)))


def demographics(populations: DataFrame, areas: DataFrame) -> DataFrame:
    """Density per km2 and its factor against the median, for matching neighbourhoods.

    Populations: barrio, population; areas: name, area_km2.
    """
    p = populations.select(text.neighbourhood_key(F.col("barrio")).alias("key"), "population")
    rows = areas.select("name", "area_km2", text.neighbourhood_key(F.col("name")).alias("key")).join(p, "key").drop("key")
    rows = rows.withColumn("density_per_km2", F.col("population") / F.col("area_km2"))
    rows = attach(rows, rows.agg(F.median("density_per_km2").alias("median_density")))
    factor = 1 + 0.5 * (F.col("density_per_km2") / F.col("median_density") - 1)
    bounded = half_even(F.greatest(F.lit(0.5), F.least(F.lit(2.0), factor)), 4)
    return rows.withColumn("density_factor", F.when(F.col("median_density") > 0, bounded).otherwise(F.lit(1.0)))
