"""Curb capacity: how many containers each street segment can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.functions import geo
from binflow.functions.numbers import half_even
from binflow.operators import spatial

# Fixed values, in metres: container length and spacing, side margins on the road and on
# the pavement, corner reserve, shortest segment, reach of corners, obstacles and lanes.
CONTAINER_LENGTH, SPACING = 1.87, 0.20
ROAD_MARGIN, PAVEMENT_MARGIN = 1.0, 6.0
CORNER_RESERVE, MIN_SEGMENT = 10.0, 5.0
CORNER_REACH, OBSTACLE_REACH, LANE_REACH = 15.0, 10.0, 6.0
# Metres blocked before and after each kind of obstacle.
BLOCKED = {"garage": (5.0, 4.0), "bus_stop": (7.5, 7.5), "kiosk": (2.5, 2.5), "loading_bay": (5.0, 5.0)}
CELL = 60.0


def corners(segments: DataFrame) -> DataFrame:
    """Whether each end of a segment meets another street within 15 m. When both ends
    meet the very same streets, only the closer end counts.

    Segments: segment_id, street (upper case), line in metres.
    """
    first, last = F.col("line")[0], F.element_at("line", -1)
    ends = segments.select(
        "segment_id", F.col("street").alias("own_street"),
        F.explode(F.array(F.struct(F.lit("start").alias("end"), first["x"].alias("x"), first["y"].alias("y")), F.struct(F.lit("end").alias("end"), last["x"].alias("x"), last["y"].alias("y")))).alias("e"),
    ).select("segment_id", "own_street", "e.end", "e.x", "e.y")
    at = spatial.on_cells(ends, F.col("x"), F.col("y"), CELL)
    laid = spatial.on_box_cells(segments.select("street", "line"), geo.bounds(F.col("line")), CELL, margin=CORNER_REACH)
    met = (
        at.join(laid, list(spatial.CELLS))
        .where(F.col("street") != F.col("own_street"))
        .withColumn("distance", geo.line_distance(F.col("x"), F.col("y"), F.col("line")))
        .where(F.col("distance") <= CORNER_REACH)
        .groupBy("segment_id", "end")
        .agg(F.array_sort(F.collect_set("street")).alias("streets"), F.min("distance").alias("d"))
    )
    both = met.groupBy("segment_id").agg(
        F.max(F.when(F.col("end") == "start", F.col("streets"))).alias("s"),
        F.max(F.when(F.col("end") == "end", F.col("streets"))).alias("t"),
        F.max(F.when(F.col("end") == "start", F.col("d"))).alias("ds"),
        F.max(F.when(F.col("end") == "end", F.col("d"))).alias("dt"),
    )
    same = F.coalesce(F.col("s") == F.col("t"), F.lit(False))
    return both.select(
        "segment_id",
        (F.col("s").isNotNull() & ~(same & (F.col("ds") > F.col("dt")))).alias("corner_start"),
        (F.col("t").isNotNull() & ~(same & (F.col("ds") <= F.col("dt")))).alias("corner_end"),
    )


def obstacles_on(segments: DataFrame, obstacles: DataFrame) -> DataFrame:
    """Obstacles within 10 m of a segment of a compatible street (either name contains the
    other, or the obstacle has none), with their position along it.

    Obstacles: kind, street (upper case, may be empty), x, y in metres.
    """
    laid = spatial.on_box_cells(segments.select("segment_id", F.col("street").alias("segment_street"), "line"), geo.bounds(F.col("line")), CELL, margin=OBSTACLE_REACH)
    at = spatial.on_cells(obstacles, F.col("x"), F.col("y"), CELL)
    name = F.coalesce("street", F.lit(""))
    compatible = (name == "") | F.contains(F.col("segment_street"), name) | F.contains(name, F.col("segment_street"))
    return (
        at.join(laid, list(spatial.CELLS))
        .where(compatible)
        .where(geo.line_distance(F.col("x"), F.col("y"), F.col("line")) <= OBSTACLE_REACH)
        .select("segment_id", "kind", geo.project_on_line(F.col("x"), F.col("y"), F.col("line")).alias("position"))
    )


def _leg_gap(a: Column, b: Column) -> Column:
    """Distance of two legs: zero when they cross, else the closest end to the other leg."""

    def side(p: Column, q: Column, r: Column) -> Column:
        return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    def away(p: Column, leg: Column) -> Column:
        return geo.segment_distance(p["x"], p["y"], leg["a"]["x"], leg["a"]["y"], leg["b"]["x"], leg["b"]["y"])

    crosses = (side(a["a"], a["b"], b["a"]) * side(a["a"], a["b"], b["b"]) < 0) & (side(b["a"], b["b"], a["a"]) * side(b["a"], b["b"], a["b"]) < 0)
    ends = F.least(away(a["a"], b), away(a["b"], b), away(b["a"], a), away(b["b"], a))
    return F.when(crosses, F.lit(0.0)).otherwise(ends)


def with_bike_lane(segments: DataFrame, lanes: DataFrame) -> DataFrame:
    """Ids of segments with a bike lane within 6 m. Lanes: line in metres."""
    box = geo.bounds(F.col("line"))
    a = spatial.on_box_cells(segments.select("segment_id", "line"), box, CELL, margin=LANE_REACH)
    b = spatial.on_box_cells(lanes.select("line"), box, CELL).withColumnRenamed("line", "lane")
    gap = F.array_min(
        F.flatten(F.transform(geo.legs(F.col("line")), lambda p: F.transform(geo.legs(F.col("lane")), lambda q: _leg_gap(p, q))))
    )
    return a.join(b, list(spatial.CELLS)).where(gap <= LANE_REACH).select("segment_id").distinct()


def blocked_intervals(segments: DataFrame, corner: DataFrame, placed: DataFrame) -> DataFrame:
    """(segment_id, low, high) blocked along each segment by corners and obstacles."""
    length = F.col("length")
    c = segments.select("segment_id", "length").join(corner, "segment_id")
    starts = c.where("corner_start").select("segment_id", F.lit(0.0).alias("low"), F.least(F.lit(CORNER_RESERVE), length).alias("high"))
    ends = c.where("corner_end").select(
        "segment_id", F.greatest(F.lit(0.0), half_even(length - CORNER_RESERVE, 2)).alias("low"), length.alias("high")
    )
    before = F.create_map(*[x for k, (b, _) in BLOCKED.items() for x in (F.lit(k), F.lit(b))])
    after = F.create_map(*[x for k, (_, e) in BLOCKED.items() for x in (F.lit(k), F.lit(e))])
    o = placed.join(segments.select("segment_id", "length"), "segment_id").select(
        "segment_id",
        F.greatest(F.lit(0.0), F.col("position") - before[F.col("kind")]).alias("low"),
        F.least(length, F.col("position") + after[F.col("kind")]).alias("high"),
    )
    return starts.unionByName(ends).unionByName(o)


def free_gaps(segments: DataFrame, blocked: DataFrame) -> DataFrame:
    """(segment_id, low, high) left between the merged blocked intervals."""
    order = Window.partitionBy("segment_id").orderBy("low", "high")
    covered = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    edges = segments.select("segment_id", F.col("length").alias("low"), F.col("length").alias("high"))
    all_rows = blocked.unionByName(edges).withColumn("covered", F.coalesce(covered, F.lit(0.0)))
    return all_rows.where(F.col("low") > F.col("covered")).select("segment_id", F.col("covered").alias("low"), F.col("low").alias("high"))


def _slots(length: Column, margin: float) -> Column:
    unit = CONTAINER_LENGTH + SPACING
    raw = F.floor((length - (2 * margin - SPACING)) / unit)
    return F.when(length >= CONTAINER_LENGTH + 2 * margin, F.greatest(F.lit(0).cast("bigint"), raw)).otherwise(F.lit(0).cast("bigint"))


def rules(segments: DataFrame, laned: DataFrame) -> DataFrame:
    """Whether the road and the pavement of each segment may hold containers.

    Needs street_type, side, general_rule and specific_rule texts (upper case).
    """
    s = segments.join(laned.withColumn("lane", F.lit(True)), "segment_id", "left")
    rule = F.when(F.coalesce("specific_rule", F.lit("")) != "", F.col("specific_rule")).otherwise(F.coalesce("general_rule", F.lit("")))
    kind = F.coalesce("street_type", F.lit("CALLE"))
    walk_only = F.contains(kind, F.lit("PEATONAL")) | F.contains(kind, F.lit("PASAJE"))
    right = F.contains(F.coalesce("side", F.lit("")), F.lit("DER"))
    right = right & ~F.contains(F.coalesce("side", F.lit("")), F.lit("IZQ"))
    road = ~F.contains(rule, F.lit("PROHIBIDO")) & ~(F.coalesce("lane", F.lit(False)) & ~right) & ~walk_only
    pavement = ~road & ~walk_only & kind.isin("AVENIDA", "BOULEVARD", "CALLE")
    return s.select("segment_id", road.alias("road"), pavement.alias("pavement"))


def capacity(segments: DataFrame, obstacles: DataFrame, lanes: DataFrame) -> DataFrame:
    """(segment_id, capacity) of every segment of at least 5 m.

    Segments: segment_id, street, line (metres), street_type, side, general_rule,
    specific_rule. Obstacles: kind, street, x, y. Lanes: line.
    """
    measured = segments.withColumn("length", half_even(geo.line_length(F.col("line")), 2))
    long_enough = measured.where(F.col("length") >= MIN_SEGMENT)
    corner = corners(measured)
    blocked = blocked_intervals(long_enough, corner, obstacles_on(long_enough, obstacles))
    gap = F.col("high") - F.col("low")
    slots = free_gaps(long_enough, blocked).groupBy("segment_id").agg(
        F.sum(_slots(gap, ROAD_MARGIN)).alias("on_road"), F.sum(_slots(gap, PAVEMENT_MARGIN)).alias("on_pavement")
    )
    allowed = rules(long_enough, with_bike_lane(long_enough, lanes))
    zero = F.lit(0).cast("bigint")
    return allowed.join(slots, "segment_id", "left").select(
        "segment_id",
        F.greatest(
            F.when(F.col("road"), F.coalesce("on_road", zero)).otherwise(zero),
            F.when(F.col("pavement"), F.coalesce("on_pavement", zero)).otherwise(zero),
        ).cast("int").alias("capacity"),
    )
