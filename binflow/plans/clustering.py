"""Sites from containers: by block and street side, or by proximity."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binflow.functions import geo, text
from binflow.operators import spatial
from binflow.session import cut, small, stored

# Metres that separate two sites of one block side, numbers that separate
# two blocks, metres of the proximity clusters.
BLOCK_METRES, BLOCK_NUMBERS, NEAR_METRES = 100.0, 100, 20.0
#: Edges, in both directions, of a component that one task walks.
COMPONENT_EDGES = 500_000
#: Pairs of spots of two boxes that are compared at once.
PAIR_TESTS = 4096
#: Cell of a group: place and range of house numbers.
CELL = ["group_key", "cell_x", "cell_y", "band"]


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): lowest node of each connected component.

    Two steps take turns until nothing changes: every node's larger neighbours, then its smaller
    ones and itself, are tied to the lowest node around it. Edges never grow in number, and the
    rounds follow the logarithm of a component's diameter. `edges` holds both directions of
    (node, other).
    """
    now, seen = cut(edges.where("node > other").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Now each edge leads from the larger node to a smaller one.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        now = cut(large.join(down, "u").select(tied.alias("e")).select("e.u", "e.v").where("u != v").distinct())
    return nodes.select("node").join(now.select(F.col("u").alias("node"), F.col("v").alias("low")), "node", "left").select(
        "node", F.coalesce("low", "node").alias("label")
    )


def _collapsed(containers: DataFrame, keys: list[str]) -> DataFrame:
    """Containers at one spot behave alike: one node per spot, named by its lowest id."""
    return containers.groupBy(*keys).agg(F.min("id").alias("node"))


def _near(metres: float) -> Column:
    return F.pow(F.col("x") - F.col("ox"), 2.0) + F.pow(F.col("y") - F.col("oy"), 2.0) <= metres * metres


def _same_block(numbers: int) -> Column:
    return F.coalesce(F.abs(F.col("number") - F.col("other_number")) < numbers, F.lit(True))


#: Ranges of the spots of a box: of the coordinates and of the house number.
_BOX = ("x0", "x1", "y0", "y1", "n0", "n1", "spots")


def _box() -> list[Column]:
    low_high = [f(c).alias(f"{n}{i}") for c, n in (("x", "x"), ("y", "y"), ("number", "n")) for i, f in enumerate((F.min, F.max))]
    return [*low_high, F.count("*").alias("spots")]


def _judged(pairs: DataFrame, metres: float, numbers: int) -> DataFrame:
    """Pairs of boxes `p` and `q` some of whose spots may be linked, with `whole`: all are, and `few`:
    they are few enough to be compared. Differences of bounds round as those of the spots do, so
    the verdict is that of the spots."""
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    wide = [F.greatest(p(f"{n}1") - q(f"{n}0"), q(f"{n}1") - p(f"{n}0")) for n in "xyn"]
    gap = [F.greatest(p(f"{n}0") - q(f"{n}1"), q(f"{n}0") - p(f"{n}1")) for n in "xyn"]
    away = [F.greatest(F.lit(0.0), g) for g in gap[:2]]
    whole = (F.pow(wide[0], 2.0) + F.pow(wide[1], 2.0) <= metres * metres) & F.coalesce(wide[2] < numbers, F.lit(True))
    apart = (F.pow(away[0], 2.0) + F.pow(away[1], 2.0) > metres * metres) | F.coalesce(gap[2] >= numbers, F.lit(False))
    return pairs.where(~apart).withColumn("whole", whole).withColumn("few", p("spots") * q("spots") <= PAIR_TESTS)


def _met(judged: DataFrame, points: Callable[[DataFrame], DataFrame], metres: float, numbers: int, side: float) -> DataFrame:
    """(la, lb) of the pairs that hold two linked spots, one in each.

    `judged`: cells a and b, their components la and lb, whole, few. Pairs of boxes with few spots
    are compared spot by spot; others halve their boxes and judge the halves, until none is open:
    boxes of one spot are always settled.
    """
    judged = stored(judged)
    open_cells = judged.where("NOT whole").select(F.explode(F.array("a", "b")).alias("cell")).distinct()
    spots = stored(points(open_cells))
    part, size, width = F.col("cell"), side, float(numbers)
    found = judged.where("whole").select("la", "lb").distinct()
    while True:
        here = spots.withColumn("at", part)
        other = here.select(F.col("at").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("number").alias("other_number"))
        compared = judged.where("few AND NOT whole").join(found, ["la", "lb"], "left_anti").join(here.withColumnRenamed("at", "a"), "a").join(other, "b")
        found = cut(found.unionByName(compared.where(_near(metres) & _same_block(numbers)).select("la", "lb")).distinct())
        rest = judged.where("NOT few AND NOT whole").join(found, ["la", "lb"], "left_anti")
        if rest.isEmpty():
            return found
        size, width, up = size / 2, width / 2, part
        halves = [geo.cell(F.col("x"), size), geo.cell(F.col("y"), size), F.coalesce(F.floor(F.col("number") / width), F.lit(-1))]
        part = F.struct("cell", *[h.alias(n) for h, n in zip(halves, "ijk")])
        boxes = cut(spots.withColumn("up", up).groupBy("up", part.alias("at")).agg(*_box()))
        p, q = (boxes.select("up", F.struct("at", *_BOX).alias(n)).withColumnRenamed("up", c) for n, c in (("p", "a"), ("q", "b")))
        pairs = rest.select("a", "b", "la", "lb").join(p, "a").join(q, "b")
        judged = cut(_judged(pairs, metres, numbers).select(F.col("p.at").alias("a"), F.col("q.at").alias("b"), "la", "lb", "whole", "few"))
        found = cut(found.unionByName(judged.where("whole").select("la", "lb")).distinct())


def _cell_clusters(cells: DataFrame, twins: DataFrame | None, points: Callable[[DataFrame], DataFrame], metres: float, numbers: int, side: float) -> DataFrame:
    """`cells` with the lowest container of each one's cluster.

    All spots of a cell are linked. Cells next to each other are tied first where their lowest
    containers are linked, which joins most cells of a crowded group; then the cells outside the
    largest component of their group meet all cells around that belong to another component.
    """
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, "ijk")]) for s in ((1, 0, 0), (0, 1, 0), (0, 0, 1))])
    ahead = cells.withColumn("s", F.explode(steps)).select(
        "group_key", *[(F.col(c) - F.col(f"s.{i}")).alias(c) for c, i in (("cell_x", "i"), ("cell_y", "j"), ("band", "k"))],
        F.col("cell").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("number").alias("other_number"),
    )
    tied = cells.join(ahead, CELL).where(_near(metres) & _same_block(numbers)).select("cell", "other")
    if twins is not None:
        tied = tied.unionByName(twins)
    first = connected(cells.select(F.col("cell").alias("node")), _downward(tied, "cell", "other"))
    named = stored(cells.drop("x", "y", "number").join(first.withColumnRenamed("node", "cell"), "cell"))
    sizes = named.groupBy("group_key", "label").agg(F.count("*").alias("cells"))
    largest = sizes.groupBy("group_key").agg(F.max_by("label", F.struct("cells", "label")).alias("largest"))
    named = named.join(largest, "group_key").withColumn("closed", F.col("label") == F.col("largest"))
    near = lambda c: F.explode(F.sequence(F.shiftright(F.col(c) - 2, 2), F.shiftright(F.col(c) + 2, 2)))
    p = F.struct("cell", "label", *CELL[1:], *_BOX).alias("p")
    q = F.struct("cell", "label", "closed", *CELL[1:], *_BOX).alias("q")
    laid = named.where("NOT closed").withColumn("tile_x", near("cell_x")).withColumn("tile_y", near("cell_y")).select("group_key", "tile_x", "tile_y", p)
    met = laid.join(named.select("group_key", F.shiftright("cell_x", 2).alias("tile_x"), F.shiftright("cell_y", 2).alias("tile_y"), q), ["group_key", "tile_x", "tile_y"])
    around = "abs(p.cell_x - q.cell_x) <= 2 AND abs(p.cell_y - q.cell_y) <= 2 AND (abs(p.band - q.band) <= 1 OR p.n0 IS NULL OR q.n0 IS NULL)"
    met = met.where(around).where("p.label != q.label AND (q.closed OR p.cell < q.cell)")
    judged = _judged(met, metres, numbers).select(
        F.col("p.cell").alias("a"), F.col("q.cell").alias("b"), F.least("p.label", "q.label").alias("la"), F.greatest("p.label", "q.label").alias("lb"), "whole", "few"
    )
    links = _met(judged, points, metres, numbers, side)
    second = connected(named.select(F.col("label").alias("node")).distinct(), _downward(links, "la", "lb")).toDF("label", "all")
    named = cut(named.select(*CELL, "cell", "node", "label").join(second, "label"))
    return named.join(named.groupBy("all").agg(F.min("node").alias("cluster")), "all").select(*CELL, "cell", "cluster")


def _downward(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))


def block_clusters(containers: DataFrame, metres: float = BLOCK_METRES, numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(id, cluster): containers of one group chained by steps of at most 100 m and under
    100 house numbers. `containers`: id, group_key (types, segment and side), address,
    latitude, longitude.

    Pairs of containers are not listed, as their number grows with the square of a crowd's:
    cells so small that all in them are linked stand for their containers (`_cell_clusters`).
    """
    keys = ["group_key", "latitude", "longitude", "number"]
    c = containers.withColumn("number", text.parse_address(F.col("address"))["number"])
    # The mean latitude is over containers, as the spots may repeat.
    means = stored(containers.groupBy("group_key").agg(F.avg("latitude").alias("mean_lat")))
    per_lat, per_lon = geo.metres_per_degree(F.col("mean_lat"))
    xy = (F.col("longitude") * per_lon).alias("x"), (F.col("latitude") * per_lat).alias("y")
    placed = stored(c.join(small(means), "group_key", "left").select("id", *keys, *xy))
    # A little under the square whose diagonal is `metres`, for the rounding of coordinates.
    side = metres / math.sqrt(2) * (1 - 1e-6)
    usable = F.col("group_key").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    band = F.coalesce(F.floor(F.col("number") / numbers), F.lit(-2))
    gridded = placed.withColumns({n: F.when(usable, v) for n, v in zip(CELL[1:], (geo.cell(F.col("x"), side), geo.cell(F.col("y"), side), band))})
    located = gridded.where("cell_x IS NOT NULL")
    known = located.where("id IS NOT NULL")
    lowest = [F.min_by(v, "id").alias(v) for v in ("x", "y", "number")]
    cells = stored(known.groupBy(*CELL).agg(F.min("id").alias("node"), *lowest, *_box()).withColumn("cell", F.monotonically_increasing_id()))

    def points(wanted: DataFrame) -> DataFrame:
        held = stored(cells.join(wanted, "cell").select(*CELL, "cell"))
        return known.join(small(held), CELL).select("cell", "x", "y", "number").distinct()

    if placed.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
        clusters = _cell_clusters(cells, None, points, metres, numbers, side)
        alone = gridded.where("cell_x IS NULL")
        spot = _collapsed(alone, keys)
        alone = alone.join(spot, [alone[k].eqNullSafe(spot[k]) for k in keys]).select("id", F.col("node").alias("cluster"))
        return located.join(clusters, CELL).select("id", "cluster").unionByName(alone)
    # A spot is named by its lowest id: spots of one name are one, wherever they lie.
    nodes = stored(_collapsed(gridded, [*keys, *CELL[1:]]).where("node IS NOT NULL"))
    held = nodes.join(cells.select(*CELL, "cell"), CELL).select("node", "cell")
    twins = held.join(held.groupBy("node").agg(F.min("cell").alias("other")), "node").where("cell != other").select("cell", "other")
    clusters = _cell_clusters(cells, twins, points, metres, numbers, side)
    named = nodes.join(clusters, CELL).select("node", "cluster").distinct()
    labels = nodes.select("node").join(named, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))
    spot = nodes.join(labels, "node").select(*keys, "cluster")
    return placed.join(spot, [placed[k].eqNullSafe(spot[k]) for k in keys]).select(placed["id"], "cluster")


def _walked(edges: pd.DataFrame) -> pd.DataFrame:
    """(node, cluster) of a component, from its edges (node, other) in both directions."""
    edges = edges.sort_values(["node", "other"])
    nodes, starts = np.unique(edges["node"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(edges)).tolist()
    others = np.searchsorted(nodes, edges["other"].to_numpy())
    cluster = np.full(len(nodes), -1, np.int64)
    for i, (lo, hi) in enumerate(zip(starts.tolist(), ends, strict=True)):
        if cluster[i] < 0:
            near = others[lo:hi]
            cluster[near[cluster[near] < 0]] = i
            cluster[i] = i
    return pd.DataFrame({"node": nodes, "cluster": nodes[cluster]})


def proximity_clusters(containers: DataFrame, metres: float = NEAR_METRES, component_edges: int = COMPONENT_EDGES) -> DataFrame:
    """(id, cluster): in id order, a container not yet taken starts a cluster and takes its
    untaken neighbours within `metres`.

    Seeds are the containers with no earlier seed nearby. A chain of containers numbered along
    a street settles one after the other, so a component of neighbours is walked in id order by
    one task if it has no more than `component_edges` edges; the larger ones go in rounds, each
    of which settles every node that is lowest among its open neighbours. `containers`: id,
    group_key, latitude, longitude.
    """
    keys = ["group_key", "latitude", "longitude"]
    nodes = _collapsed(containers, keys)
    weighted = containers.groupBy("group_key").agg(F.avg("latitude").alias("mean_lat"))
    per_lat, per_lon = geo.metres_per_degree(F.col("mean_lat"))
    placed = cut(nodes.join(weighted, "group_key").withColumn("x", F.col("longitude") * per_lon).withColumn("y", F.col("latitude") * per_lat))
    a = placed.select("group_key", "node", "x", "y")
    b = placed.select("group_key", F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = spatial.grid_join(a, b, metres, (F.col("x"), F.col("y")), (F.col("ox"), F.col("oy")), ("group_key",))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    edges = cut(pairs.where((F.col("node") != F.col("other")) & (dx * dx + dy * dy <= metres * metres)).select("node", "other"))
    parts = connected(edges.select("node").distinct(), edges)
    named = edges.join(parts, "node")
    sizes = named.groupBy("label").agg(F.count("*").alias("edges"))
    named = cut(named.join(sizes, "label"))
    ids = dict(edges.dtypes)["node"]
    label = named.where(F.col("edges") <= component_edges).select("label", "node", "other").groupBy("label").applyInPandas(
        lambda rows: _walked(rows[["node", "other"]]), f"node {ids}, cluster {ids}"
    )
    label = label.unionByName(placed.join(edges, "node", "left_anti").select("node", F.col("node").alias("cluster")))
    large = named.where(F.col("edges") > component_edges).select("node", "other")
    if not large.isEmpty():
        label = label.unionByName(_in_rounds(cut(large)))
    spot = placed.join(label, "node").select(*keys, "cluster")
    return containers.join(spot, keys).select("id", "cluster")


def _in_rounds(edges: DataFrame) -> DataFrame:
    """(node, cluster) of components that no task walks."""
    open_nodes = edges.select("node").distinct()
    seeds = None
    while True:
        open_edges = edges.join(open_nodes, "node", "left_semi").join(open_nodes.withColumnRenamed("node", "other"), "other", "left_semi")
        lowest = open_edges.groupBy("node").agg(F.min("other").alias("lowest"))
        new = cut(open_nodes.join(lowest, "node", "left").where(F.col("lowest").isNull() | (F.col("node") < F.col("lowest"))).select("node"))
        if new.isEmpty():
            break
        seeds = new if seeds is None else cut(seeds.unionByName(new))
        taken = edges.join(new.withColumnRenamed("node", "other"), "other", "left_semi").select("node").unionByName(new).distinct()
        open_nodes = cut(open_nodes.join(taken, "node", "left_anti"))
    owner = edges.join(seeds.withColumnRenamed("node", "other"), "other", "left_semi").groupBy("node").agg(F.min("other").alias("owner"))
    return seeds.select("node", F.col("node").alias("cluster")).unionByName(
        owner.join(seeds, "node", "left_anti").select("node", F.col("owner").alias("cluster"))
    )


def side_groups(containers: DataFrame, placed: DataFrame, types: DataFrame, links: DataFrame) -> DataFrame:
    """Group key of the block clusters: waste kind, type, street segment and side. Two-sided
    and buried types count as BILATERAL except on avenues.

    `placed` is the output of `nearest_street` keyed by id.
    """
    kinds = links.groupBy("container_type_id").agg(F.min("waste_type_id").alias("waste_type_id"))
    name = F.upper(F.coalesce("type_name", F.lit("")))
    t = types.select(F.col("id").alias("container_type_id"), F.col("name").alias("type_name")).join(kinds, "container_type_id", "left")
    two_sided = F.contains(name, F.lit("BILATERAL")) | F.contains(name, F.lit("SOTERRADO"))
    rows = containers.join(placed, "id").join(small(t), "container_type_id", "left")
    side = F.when(two_sided & ~F.col("is_avenue"), "BILATERAL").otherwise(F.col("load_side"))
    part = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("waste_type_id", "container_type_id", "street_id")]
    return rows.withColumn("side", side).withColumn("group_key", F.concat_ws("/", *part, "side"))


def create_sites(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Site rows from clusters, and the containers with their new site.

    `members`: id, cluster, latitude, longitude, address, type_name, side, waste_type_id.
    The site takes its cluster's number, centroid and first container's address.
    """
    first = F.struct("address", "type_name", "side", "waste_type_id")
    rolled = members.groupBy(F.col("cluster").alias("site_id")).agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count("*").alias("containers"), F.min_by(first, "id").alias("f")
    )
    address = F.coalesce("f.address", F.format_string("Lat %.5f, Lon %.5f", "latitude", "longitude"))
    sites = rolled.select(
        "site_id",
        F.concat(F.lit("Sitio "), F.coalesce("f.type_name", F.lit("RSU")), F.lit(" - "), address).alias("name"),
        F.concat(F.lit("Sitio con "), "containers", F.lit(" contenedor(es)")).alias("description"),
        F.col("f.address").alias("address"), "latitude", "longitude",
        F.col("f.side").alias("load_side_category"), F.col("f.waste_type_id").alias("waste_type_id"), "containers",
    )
    linked = members.select("id", F.col("cluster").alias("site_id")).join(sites.select("site_id", F.col("name").alias("site_name")), "site_id")
    return sites, linked
