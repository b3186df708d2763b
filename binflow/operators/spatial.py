"""Distance joins over a grid of cells, without cross joins.

Each side gets the cell of its coordinates; the right side is laid on the nine cells
around it, so any pair within one cell size meets exactly once on an equality key that
Spark can hash, split and skew-handle. `salt` splits crowded cells further: the left
side spreads over `salt` sub-keys and the right side repeats on each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binflow.functions import geo
from binflow.session import cut

CELLS = ("cell_x", "cell_y")


def on_cells(df: DataFrame, x: Column, y: Column, size: Column | float) -> DataFrame:
    return df.withColumn("cell_x", geo.cell(x, size)).withColumn("cell_y", geo.cell(y, size))


def on_neighbour_cells(df: DataFrame, x: Column, y: Column, size: Column | float) -> DataFrame:
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = df.withColumn("_step", F.explode(around))
    return (
        spread.withColumn("cell_x", geo.cell(x, size) + F.col("_step.i"))
        .withColumn("cell_y", geo.cell(y, size) + F.col("_step.j"))
        .drop("_step")
    )


def on_box_cells(df: DataFrame, box: tuple[Column, Column, Column, Column], size: float, margin: float = 0.0) -> DataFrame:
    """One row per cell a bounding box (grown by `margin`) touches."""
    x0, y0, x1, y1 = box
    xs = F.sequence(geo.cell(x0 - margin, size), geo.cell(x1 + margin, size))
    ys = F.sequence(geo.cell(y0 - margin, size), geo.cell(y1 + margin, size))
    return df.withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))


def grid_join(
    left: DataFrame, right: DataFrame, size: Column | float, left_xy: tuple[Column, Column], right_xy: tuple[Column, Column],
    on: Sequence[str] = (), salt: int = 1,
) -> DataFrame:
    """Candidate pairs whose cells touch; callers apply their exact distance. Column
    names of the two sides must differ apart from `on`."""
    a = on_cells(left, *left_xy, size)
    b = on_neighbour_cells(right, *right_xy, size)
    keys = [*on, *CELLS]
    if salt > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64(*left_xy), F.lit(salt)))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))))
        keys.append("_salt")
    return a.join(b, keys).drop(*CELLS, "_salt")


def haversine_pairs(
    left: DataFrame, right: DataFrame, max_km: float, on: Sequence[str] = (), left_prefix: str = "donor", right_prefix: str = "receiver", salt: int = 1
) -> DataFrame:
    """Pairs within `max_km` on the sphere that agree on the `on` columns (nulls agree).

    Sides carry `{prefix}_latitude` and `{prefix}_longitude`. Rows lie in bands of latitude as
    high as `max_km`, and each band cuts longitude at a scale of its own, that of the highest
    latitude its pairs can have: a lower bound of the true distance, so no pair is lost, and a
    row near a pole widens no cells but those of its neighbours.
    """
    names = [f"{p}_{c}" for p in (left_prefix, right_prefix) for c in ("latitude", "longitude")]
    la, lo, ra, ro = (F.col(n) for n in names)
    filled = [f"_on_{i}" for i in range(len(on))]
    a = left.withColumns({f: F.coalesce(F.col(c).cast("string"), F.lit("")) for f, c in zip(filled, on)})
    b = right.withColumns({f: F.coalesce(F.col(c).cast("string"), F.lit("")) for f, c in zip(filled, on)}).drop(*on)
    # Slightly larger cells than max_km asks for cover the rounding of the distance.
    high = max(max_km, 1e-9) * 1.001
    band = lambda lat: F.floor(F.lit(geo.EARTH_RADIUS_KM) * F.radians(lat) / high)

    def column(lon: Column, band_of: Column) -> Column:
        edge = F.least(F.lit(math.pi / 2), (F.abs(band_of) + 2) * (high / geo.EARTH_RADIUS_KM))
        return F.floor(F.lit(0.999 * geo.EARTH_RADIUS_KM) * F.cos(edge) * F.radians(lon) / high)

    steps = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
    a = a.withColumn("cell_y", band(la))
    a = a.withColumn("cell_x", column(lo, F.col("cell_y")))
    b = b.withColumn("_dy", F.explode(steps)).withColumn("cell_y", band(ra) + F.col("_dy"))
    b = b.withColumn("_dx", F.explode(steps)).withColumn("cell_x", column(ro, F.col("cell_y")) + F.col("_dx")).drop("_dx", "_dy")
    keys = [*filled, *CELLS]
    if salt > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64(la, lo), F.lit(salt)))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))))
        keys.append("_salt")
    pairs = a.join(b, keys).drop(*CELLS, "_salt", *filled)
    return pairs.withColumn("distance_km", geo.haversine_km(la, lo, ra, ro)).where(F.col("distance_km") <= max_km)


def planar_pairs(sites: DataFrame, max_km: float, group: str = "group_key", salt: int = 1) -> DataFrame:
    """Ordered pairs (donor, receiver) of different sites of one group within `max_km`,
    on kilometres projected around the group's mean latitude.

    `sites` has site_id, latitude, longitude, `group`, can_donate, can_receive.
    """
    means = sites.groupBy(group).agg(F.avg("latitude").alias("mean_lat"))
    x, y = geo.planar_km(F.col("latitude"), F.col("longitude"), F.col("mean_lat"))
    placed = sites.join(means, group).withColumn("x", x).withColumn("y", y)
    donors = placed.where("can_donate").select(group, F.col("site_id").alias("donor_id"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    receivers = placed.where("can_receive").select(group, F.col("site_id").alias("receiver_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = grid_join(donors, receivers, max_km, (F.col("dx"), F.col("dy")), (F.col("rx"), F.col("ry")), (group,), salt)
    return (
        pairs.where(F.col("donor_id") != F.col("receiver_id"))
        .withColumn("distance_km", F.hypot(F.col("dx") - F.col("rx"), F.col("dy") - F.col("ry")))
        .where(F.col("distance_km") <= max_km)
        .select(group, "donor_id", "receiver_id", "distance_km")
    )


def nearest(
    points: DataFrame, targets: DataFrame, point_key: str, xy: tuple[Column, Column], box: tuple[Column, Column, Column, Column],
    distance: Column, start: float, order: Sequence[str],
) -> DataFrame:
    """Closest target of every point, however far; a row of nulls where there is none.

    Round k looks within `start * 2**k`: targets cover the cells of their box grown by
    that much, so a hit no farther than the cell size is final. Points still open go on
    with doubled cells, and only cells that hold open points join anything. Points without
    coordinates meet no target; the rest are done at the latest when a cell is larger than
    everything present. Rounds carry a target's number; its columns join the points at the end.
    """
    placed = cut(points.select(point_key, xy[0].cast("double").alias("_px"), xy[1].cast("double").alias("_py")))

    def usable(*values: Column) -> Column:
        known = [v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) for v in values]
        return F.coalesce(reduce(lambda a, b: a & b, known), F.lit(False))

    payload = list(targets.columns)
    targets = cut(targets.where(usable(*[b.cast("double") for b in box])).withColumn("_target", F.monotonically_increasing_id()))
    rest = placed.where(usable(F.col("_px"), F.col("_py")))
    reach = targets.select(*[F.abs(b).alias(f"b{i}") for i, b in enumerate(box)]).agg(F.max(F.greatest("b0", "b1", "b2", "b3")).alias("t")).first().t
    farthest = rest.agg(F.max(F.greatest(F.abs("_px"), F.abs("_py"))).alias("p")).first().p
    found: list[DataFrame] = []
    size = start
    first = F.struct("_distance", *order, "_target")
    while reach is not None and farthest is not None:
        here = on_cells(rest, F.col("_px"), F.col("_py"), size)
        laid = on_box_cells(targets, box, size, margin=size)
        best = (
            here.join(laid, list(CELLS))
            .withColumn("_distance", distance)
            .where(F.col("_distance") <= size)
            .groupBy(point_key)
            .agg(F.min(first).alias("hit"))
        )
        best = cut(best.select(point_key, F.col("hit._distance").alias("distance"), "hit._target"))
        found.append(best)
        rest = cut(rest.join(best.select(point_key), point_key, "left_anti"))
        if size > 4 * (reach + farthest) or rest.isEmpty():
            break
        size *= 2
    settled = reduce(DataFrame.unionByName, found) if found else None
    if settled is None:
        kinds = {c: targets.schema[c].dataType for c in payload}
        none = [F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
        return placed.select(point_key, F.lit(None).cast("double").alias("distance"), *none)
    settled = settled.join(targets, "_target").select(point_key, "distance", *payload)
    return placed.select(point_key).distinct().join(settled, point_key, "left")
