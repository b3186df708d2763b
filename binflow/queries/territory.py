"""Checks of the territory joins, clustering and curb capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow import adapter as a
from binflow.functions import geo
from binflow.functions.numbers import half_up as up
from binflow.operators import filters, territory
from binflow.plans import clustering, curb
from binflow.queries.duck import add_cte, half_even, half_up, with_ctes
from binflow.queries.registry import query

_X0 = "-58.53e0 + (s_suppkey // 25) * 5e-3"
_Y0 = "-34.70e0 + (s_suppkey % 25) * 4e-3"


def _origin():
    k = F.col("s_suppkey")
    return F.lit(-58.53) + F.expr("s_suppkey div 25") * F.lit(0.005), F.lit(-34.70) + (k % 25) * F.lit(0.004)


def _points(x, y, offsets):
    return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in offsets])


_STREET = ((-0.002, 0.0002), (0.001, 0.0006), (0.002, 0.0001))
_SQUARE = ((-0.0022, -0.0018), (0.0024, -0.0021), (0.0020, 0.0019), (-0.0021, 0.0017), (-0.0022, -0.0018))


def streets(spark, sf):
    x, y = _origin()
    k = F.col("s_suppkey")
    return a.table(spark, sf, "supplier").select(
        k.alias("street_id"),
        F.expr("concat('LINEA ', chr(65 + s_suppkey div 10 % 26), chr(65 + s_suppkey div 260 % 26))").alias("name"),
        F.when(k % 3 == 0, "DOBLE").when(k % 3 == 1, "CRECIENTE").otherwise("DECRECIENTE").alias("direction"),
        F.when(k % 5 == 0, "AVENIDA").otherwise("CALLE").alias("street_type"),
        _points(x, y, _STREET).alias("line"),
    )


def polygons(spark, sf):
    x, y = _origin()
    return a.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("polygon_id"), F.array(_points(x, y, _SQUARE)).alias("rings"))


def spots(spark, sf):
    k = F.col("c_custkey")
    return a.table(spark, sf, "customer").select(
        k.alias("id"),
        (F.lit(-58.533) + k * 7919 % 10007 / F.lit(10007.0) * F.lit(0.022)).alias("x"),
        (F.lit(-34.703) + k * 104729 % 10009 / F.lit(10009.0) * F.lit(0.102)).alias("y"),
    )


def _rows(offsets) -> str:
    pairs = list(zip(offsets[:-1], offsets[1:]))
    return ", ".join(f"({i}, {p[0]}e0, {p[1]}e0, {q[0]}e0, {q[1]}e0)" for i, (p, q) in enumerate(pairs))


add_cte("spots", "", "SELECT c_custkey AS id, -58.533e0 + c_custkey * 7919 % 10007 / 10007e0 * 22e-3 AS x, -34.703e0 + c_custkey * 104729 % 10009 / 10009e0 * 102e-3 AS y FROM customer")
add_cte(
    "edges", "",
    f"SELECT s_suppkey AS polygon_id, i, {_X0} + x1 AS ax, {_Y0} + y1 AS ay, {_X0} + x2 AS qx, {_Y0} + y2 AS qy FROM supplier, (VALUES {_rows(_SQUARE)}) v(i, x1, y1, x2, y2)",
)
add_cte(
    "legs", "",
    "SELECT s_suppkey AS street_id, CASE s_suppkey % 3 WHEN 0 THEN 'DOBLE' WHEN 1 THEN 'CRECIENTE' ELSE 'DECRECIENTE' END AS direction, s_suppkey % 5 = 0 AS is_avenue,"
    f" i AS leg, {_X0} + x1 AS ax, {_Y0} + y1 AS ay, {_X0} + x2 AS qx, {_Y0} + y2 AS qy FROM supplier, (VALUES {_rows(_STREET)}) v(i, x1, y1, x2, y2)",
)
_T = "greatest(0e0, least(1e0, ((p.x - ax) * (qx - ax) + (p.y - ay) * (qy - ay)) / ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay))))"
_DIST = f"sqrt(pow(p.x - (ax + {_T} * (qx - ax)), 2) + pow(p.y - (ay + {_T} * (qy - ay)), 2))"
add_cte(
    "inside", "spots edges",
    "SELECT id, min(polygon_id) AS polygon_id FROM (SELECT p.id, polygon_id FROM spots p, edges WHERE (ay > p.y) <> (qy > p.y) AND p.x < (qx - ax) * (p.y - ay) / (qy - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY id",
)


@query("c09_point_in_polygon", with_ctes("inside", "SELECT id, polygon_id FROM inside"))
def _c09(spark, sf):
    return territory.locate(spots(spark, sf), polygons(spark, sf), 0.005)


@query(
    "c15_point_or_nearest_polygon",
    with_ctes(
        "inside",
        f"SELECT id, polygon_id FROM inside UNION ALL SELECT id, arg_min(polygon_id, (d, polygon_id)) FROM (SELECT p.id, polygon_id, min({_DIST}) AS d FROM spots p, edges WHERE p.id NOT IN (SELECT id FROM inside) GROUP BY ALL) GROUP BY id",
    ),
)
def _c15(spark, sf):
    return territory.locate_or_nearest(spots(spark, sf), polygons(spark, sf), 0.005)


@query(
    "c10_nearest_street_and_side",
    with_ctes(
        "spots legs",
        "SELECT id, h.street_id, h.is_avenue, CASE WHEN h.direction = 'DOBLE' THEN 'BILATERAL' WHEN (h.direction = 'DECRECIENTE') = left_side THEN 'DERECHA' ELSE 'IZQUIERDA' END AS load_side FROM (SELECT id, arg_min({'street_id': street_id, 'direction': direction, 'is_avenue': is_avenue, 'left_side':"
        f" (qx - ax) * (y - ay) - (qy - ay) * (x - ax) > 0}}, (d, street_id, leg)) AS h FROM (SELECT p.*, legs.*, {_DIST} AS d FROM spots p, legs) GROUP BY id), LATERAL (SELECT h.left_side AS left_side)",
    ),
)
def _c10(spark, sf):
    return territory.nearest_street(spots(spark, sf), streets(spark, sf), 0.0005).select("id", "street_id", "is_avenue", "load_side")


def _sites(spark, sf):
    return filters.active(a.sites(spark, sf)).select(
        F.col("id").alias("site_id"), "name", "address", "latitude", "longitude", F.expr("cast(id % 4 as int)").alias("containers")
    )


def _capacity_segments(spark, sf):
    x, y = _origin()
    k = F.col("s_suppkey")
    far = F.when(k % 7 == 6, F.lit(0.001)).when(k % 3 == 0, F.lit(0.00028)).otherwise(F.lit(0.0001))
    line = F.array(F.struct((x - 0.001).alias("x"), (y + far).alias("y")), F.struct((x + 0.001).alias("x"), (y + far).alias("y")))
    return a.table(spark, sf, "supplier").select(k.alias("segment_id"), (k % 5).cast("int").alias("capacity"), line.alias("line"))


def _utm(source: str, keep: str) -> str:
    """DuckDB text: `keep` and the projected x, y of a source's longitude x and latitude y, on the
    parameters of UTM 21 south."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    e = 2 * n**0.5 / (1 + n)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
    )
    east = " + ".join(f"{c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(alpha, 1))
    north = " + ".join(f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(alpha, 1))
    return (
        f"SELECT {keep}, 500000 + {a!r} * (eta + {east}) AS x, 10000000 + {a!r} * (xi + {north}) AS y FROM (SELECT {keep}, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM"
        f" (SELECT {keep}, radians(x + 57) AS l, sinh(atanh(sin(radians(y))) - {e!r} * atanh({e!r} * sin(radians(y)))) AS t FROM {source}))"
    )


add_cte("metric_sites", "live_sites", _utm("(SELECT id, longitude AS x, latitude AS y FROM live_sites)", "id"))
_FAR = "CASE WHEN s_suppkey % 7 = 6 THEN 1e-3 WHEN s_suppkey % 3 = 0 THEN 28e-5 ELSE 1e-4 END"
add_cte(
    "metric_ends", "",
    _utm(f"(SELECT s_suppkey AS segment_id, s_suppkey % 5 AS capacity, e, {_X0} + (2 * e - 1) * 1e-3 AS x, {_Y0} + {_FAR} AS y FROM supplier, (VALUES (0), (1)) v(e))", "segment_id, capacity, e"),
)
add_cte(
    "ruled", "metric_sites metric_ends",
    "SELECT id, arg_min({'segment_id': segment_id, 'capacity': capacity, 'length': sqrt(pow(qx - ax, 2) + pow(qy - ay, 2))}, CASE WHEN d <= 25 THEN {'far': 0, 'a': CAST(-capacity AS DOUBLE), 's': segment_id} ELSE {'far': 1, 'a': d, 's': segment_id} END) AS g"
    f" FROM (SELECT *, {_DIST} AS d FROM metric_sites p, (SELECT s.segment_id, s.capacity, s.x AS ax, s.y AS ay, t.x AS qx, t.y AS qy FROM metric_ends s JOIN metric_ends t ON s.segment_id = t.segment_id AND s.e = 0 AND t.e = 1)) WHERE d <= 35 GROUP BY id",
)


@query(
    "c11_segment_capacity",
    with_ctes("ruled", f"SELECT id AS site_id, g.segment_id AS segment_id, CAST(g.capacity AS INTEGER) AS segment_capacity, {half_up('g.length', 6)} AS length_m FROM ruled"),
)
def _c11(spark, sf):
    ruled = territory.segment_capacity(_sites(spark, sf), _capacity_segments(spark, sf))
    return ruled.withColumn("length_m", up(F.col("length_m"), 6))


@query(
    "i23_capacity_verdict",
    with_ctes(
        "live_sites ruled",
        "SELECT site_id, CAST(CASE WHEN blocked THEN greatest(1, n) ELSE greatest(1, c) END AS INTEGER) AS max_containers, NOT blocked AND greatest(1, c) > n AS may_enter, CAST(CASE WHEN blocked THEN 0 ELSE greatest(0, greatest(1, c) - n) END AS INTEGER) AS free_slots,"
        f" CASE WHEN c IS NULL THEN 'SIN_TRAMO_CERCANO' END AS status, CASE WHEN c IS NULL THEN 0e0 ELSE greatest(5e0, least(4e2, {half_even('l', 2)})) END AS length_m"
        " FROM (SELECT s.id AS site_id, s.id % 4 AS n, g.capacity AS c, g.length AS l, g.capacity IS NULL OR g.capacity <= 0 AS blocked FROM live_sites s LEFT JOIN ruled r ON r.id = s.id)",
    ),
)
def _i23(spark, sf):
    s = _sites(spark, sf)
    return territory.capacity_verdict(s, territory.segment_capacity(s, _capacity_segments(spark, sf)))


@query("h05_transverse_mercator", with_ctes("spots", f"SELECT id, {half_up('x', 3)} AS east, {half_up('y', 3)} AS north FROM ({_utm('spots', 'id')})"))
def _h05(spark, sf):
    x, y = geo.project(F.col("y"), F.col("x"), geo.UTM_21_SOUTH)
    return spots(spark, sf).select("id", up(x, 3).alias("east"), up(y, 3).alias("north"))


@query(
    "h13_line_measures",
    with_ctes(
        "legs",
        f"SELECT street_id, {half_up('sum(sqrt(pow(qx - ax, 2) + pow(qy - ay, 2)))', 9)} AS length FROM legs GROUP BY street_id",
    ),
)
def _h13(spark, sf):
    return streets(spark, sf).select("street_id", up(geo.line_length(F.col("line")), 9).alias("length"))


# A slanting tract over the gap between two polygons, and a sliver in it.
_TRACT = ((0.0, 0.0), (0.0032, 0.0002), (0.0030, 0.0010), (0.0001, 0.0002), (0.0, 0.0))
_STRIP = (
    "sign(t.qx - t.ax) * sign(p.qx - p.ax) * (hi - lo) * ((ql + qr) / 2 + CASE WHEN pl < ql AND pr > qr THEN -pow(ql - pl, 2) / (pr - qr + ql - pl) / 2"
    " WHEN pl > ql AND pr < qr THEN -pow(qr - pr, 2) / (pl - ql + qr - pr) / 2 ELSE (least(pl - ql, 0) + least(pr - qr, 0)) / 2 END)"
)
add_cte(
    "tract_edges", "",
    f"SELECT CAST(s_suppkey AS VARCHAR) AS radio_code, {_X0} + 15e-4 + x1 AS ax, {_Y0} + 4e-4 + y1 AS ay, {_X0} + 15e-4 + x2 AS qx, {_Y0} + 4e-4 + y2 AS qy FROM supplier, (VALUES {_rows(_TRACT)}) v(i, x1, y1, x2, y2)",
)


def _shared_area(p: str, key: str) -> str:
    height = lambda e, x: f"({e}.ay - t0 + ({e}.qy - {e}.ay) * ({x} - {e}.ax) / ({e}.qx - {e}.ax))"
    lo, hi = "greatest(least(t.ax, t.qx), least(p.ax, p.qx))", "least(greatest(t.ax, t.qx), greatest(p.ax, p.qx))"
    return (
        f"SELECT t.radio_code, p.{key}, abs(sum({_STRIP})) AS area FROM tract_edges t, {p} p, (SELECT -34.8e0 AS t0), LATERAL (SELECT {lo} AS lo, {hi} AS hi),"
        f" LATERAL (SELECT {height('t', 'lo')} AS pl, {height('t', 'hi')} AS pr, {height('p', 'lo')} AS ql, {height('p', 'hi')} AS qr) WHERE t.ax <> t.qx AND p.ax <> p.qx AND lo < hi GROUP BY ALL"
    )


@query(
    "c13_largest_overlap",
    with_ctes(
        "tract_edges edges",
        f"SELECT radio_code, arg_max(polygon_id, (share, -polygon_id)) AS polygon_id FROM (SELECT s.radio_code, s.polygon_id, round(s.area / o.area, 6) AS share FROM ({_shared_area('edges', 'polygon_id')}) s"
        f" JOIN ({_shared_area('(SELECT radio_code AS own, * EXCLUDE radio_code FROM tract_edges)', 'own')}) o ON s.radio_code = o.radio_code AND o.own = o.radio_code) WHERE share > 0 GROUP BY radio_code",
    ),
)
def _c13(spark, sf):
    x, y = _origin()
    tracts = a.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("radio_code"), F.array(_points(x + 0.0015, y + 0.0004, _TRACT)).alias("rings"))
    return territory.largest_overlap(tracts, polygons(spark, sf), 0.005)


def _street_rows(spark, sf):
    k = F.col("s_suppkey")
    x, y = _origin()
    return a.table(spark, sf, "supplier").select(
        k.alias("seq"), F.expr("concat('LINEA ', chr(65 + s_suppkey div 10 % 26), chr(65 + s_suppkey div 260 % 26), ', AV.')").alias("nomoficial"),
        F.lit("").alias("nom_mapa"), (1 + k % 10 * 100).alias("alt_izqini"), (99 + k % 10 * 100).alias("alt_izqfin"),
        (2 + k % 10 * 100).alias("alt_derini"), (100 + k % 10 * 100).alias("alt_derfin"), _points(x, y, ((0.0, 0.0), (0.002, 0.0))).alias("line"),
    )


@query(
    "c14_geocoded_addresses",
    "SELECT street, number, " + half_up("x0 + 2e-3 * f", 7) + " AS x, " + half_up("y0", 7) + " AS y FROM (SELECT a.street, a.number, x0, y0, CASE WHEN number BETWEEN lo AND hi THEN (number - lo) / (hi - lo) ELSE 5e-1 END AS f, row_number() OVER (PARTITION BY a.street, a.number ORDER BY NOT number BETWEEN lo AND hi, CASE WHEN number BETWEEN lo AND hi THEN 0 ELSE least(abs(lo - number), abs(hi - number)) END, seq) AS k"
    " FROM (SELECT DISTINCT 'Linea ' || chr(CAST(65 + c_custkey % 7 AS INTEGER)) || 'A' || CASE WHEN c_custkey % 3 = 0 THEN ' av' ELSE '' END AS street, 'LINEA ' || chr(CAST(65 + c_custkey % 7 AS INTEGER)) || 'A' AS bare, CAST(c_custkey % 1300 AS INTEGER) AS number FROM customer) a"
    f" JOIN (SELECT s_suppkey AS seq, 'LINEA ' || chr(CAST(65 + s_suppkey // 10 % 26 AS INTEGER)) || chr(CAST(65 + s_suppkey // 260 % 26 AS INTEGER)) AS bare, 1 + s_suppkey % 10 * 100 AS lo, 100 + s_suppkey % 10 * 100 AS hi, {_X0} AS x0, {_Y0} AS y0 FROM supplier) s ON s.bare = a.bare) WHERE k = 1",
)
def _c14(spark, sf):
    k = F.col("c_custkey")
    street = F.concat(F.lit("Linea "), F.expr("chr(65 + c_custkey % 7)"), F.lit("A"), F.when(k % 3 == 0, " av").otherwise(""))
    addresses = a.table(spark, sf, "customer").select(street.alias("street"), (k % 1300).cast("int").alias("number"))
    found = territory.geocode(addresses, territory.street_ranges(_street_rows(spark, sf)))
    return found.select("street", "number", up(F.col("x"), 7).alias("x"), up(F.col("y"), 7).alias("y"))


def _segments(spark, sf):
    k = F.col("s_suppkey")
    return a.table(spark, sf, "supplier").select(
        F.concat(F.lit("R"), F.expr("s_suppkey div 7")).alias("route_id"), F.expr("s_suppkey div 7").alias("route_rank"), (k % 7).alias("segment"),
        F.expr("concat(if(s_suppkey % 20 < 10, 'AV. LINEA ', 'OTRA '), chr(65 + s_suppkey div 10 % 26), chr(65 + s_suppkey div 260 % 26))").alias("street_name"),
        (100 + k % 10 * 20).alias("alt_start"), (101 + k % 10 * 20).alias("alt_end"),
    )


add_cte(
    "segments", "",
    "SELECT 'R' || (s_suppkey // 7) AS route_id, s_suppkey // 7 AS route_rank, s_suppkey % 7 AS segment, CASE WHEN s_suppkey % 20 < 10 THEN 'AV. LINEA ' ELSE 'OTRA ' END || chr(CAST(65 + s_suppkey // 10 % 26 AS INTEGER)) || chr(CAST(65 + s_suppkey // 260 % 26 AS INTEGER)) AS street,"
    " 100 + s_suppkey % 10 * 20 AS lo, 101 + s_suppkey % 10 * 20 AS hi FROM supplier",
)
add_cte(
    "numbered", "live_sites",
    "SELECT id, latitude, longitude, rtrim(rtrim(address, '0123456789')) AS street, CAST(regexp_extract(address, '(\\d+)$', 1) AS INTEGER) AS number FROM live_sites",
)
add_cte(
    "by_street", "segments numbered",
    "SELECT id, latitude, longitude, arg_min(route_id, (NOT number BETWEEN lo - 50 AND hi + 50, route_rank, segment)) AS route_id, arg_min(segment, (NOT number BETWEEN lo - 50 AND hi + 50, route_rank, segment)) AS stop_order FROM numbered JOIN segments USING (street) GROUP BY ALL",
)
add_cte(
    "centres", "by_street segments",
    "SELECT r.route_id, coalesce(avg(latitude), -34.6402e0) AS clat, coalesce(avg(longitude), -58.4101e0) AS clon FROM (SELECT DISTINCT route_id FROM segments) r LEFT JOIN by_street b ON b.route_id = r.route_id GROUP BY 1",
)


@query(
    "c16_site_routes",
    with_ctes(
        "centres numbered by_street",
        "SELECT id AS site_id, route_id, stop_order FROM by_street UNION ALL SELECT id, arg_min(route_id, (sqrt(pow(latitude - clat, 2) + pow((longitude - clon) * cos(radians((latitude + clat) / 2)), 2)), route_id)), 1000000000 FROM numbered, centres WHERE id NOT IN (SELECT id FROM by_street) GROUP BY id",
    ),
)
def _c16(spark, sf):
    s = _segments(spark, sf)
    centres = s.select("route_id").distinct().withColumn("latitude", F.lit(-34.6402)).withColumn("longitude", F.lit(-58.4101))
    return territory.assign_routes(_sites(spark, sf), s, centres).select("site_id", "route_id", "stop_order")


@query(
    "c17_opposing_sites",
    with_ctes(
        "numbered",
        "SELECT site_id, opposing_id FROM (SELECT min(e) AS site_id, o AS opposing_id FROM (SELECT e.id AS e, arg_min(o.id, (sqrt(pow((o.latitude - e.latitude) * 111000e0, 2) + pow((o.longitude - e.longitude) * 111000e0 * cos(radians((e.latitude + o.latitude) / 2)), 2)), o.id)) AS o FROM numbered e JOIN numbered o ON o.street = e.street AND e.number % 2 = 0 AND o.number % 2 = 1"
        " AND abs(e.number - o.number) <= 60 AND sqrt(pow((o.latitude - e.latitude) * 111000e0, 2) + pow((o.longitude - e.longitude) * 111000e0 * cos(radians((e.latitude + o.latitude) / 2)), 2)) <= 500 GROUP BY e.id) GROUP BY o) p"
        ", LATERAL (SELECT 1)",
    ).replace("SELECT site_id, opposing_id FROM (SELECT min(e)", "SELECT unnest([site_id, opposing_id]) AS site_id, unnest([opposing_id, site_id]) AS opposing_id FROM (SELECT min(e)"),
)
def _c17(spark, sf):
    return territory.opposing_sites(_sites(spark, sf), max_metres=500.0)


def _metre_segments(spark, sf):
    """Suppliers as street segments on a metric grid: blocks of 100 m meeting at corners."""
    k = F.col("s_suppkey")
    row, col = F.expr("s_suppkey div 25"), k % 25
    across = k % 2 == 0
    x, y = col * 105.0, row * 105.0
    b = F.when(across, F.struct((x + 100.0).alias("x"), y.alias("y"))).otherwise(F.struct(x.alias("x"), (y + 100.0).alias("y")))
    return a.table(spark, sf, "supplier").select(
        k.alias("segment_id"),
        F.when(across, F.concat(F.lit("FILA "), row)).otherwise(F.concat(F.lit("COLUMNA "), col)).alias("street"),
        F.array(F.struct(x.alias("x"), y.alias("y")), b).alias("line"),
        F.when(k % 11 == 0, "PASAJE").when(k % 5 == 0, "AVENIDA").otherwise("CALLE").alias("street_type"),
        F.when(k % 2 == 0, "DERECHO").otherwise("IZQUIERDO").alias("side"),
        F.when(k % 7 == 0, "PROHIBIDO ESTACIONAR").otherwise("PERMITIDO").alias("general_rule"),
        F.lit("").alias("specific_rule"),
    )


def _obstacles(spark, sf):
    k = F.col("c_custkey")
    return a.table(spark, sf, "customer").select(
        F.when(k % 4 == 0, "garage").when(k % 4 == 1, "bus_stop").when(k % 4 == 2, "kiosk").otherwise("loading_bay").alias("kind"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("FILA "), F.expr("c_custkey % 4"))).alias("street"),
        (k * 7919 % 2600).cast("double").alias("x"), (k * 104729 % 420).cast("double").alias("y"),
    )


add_cte(
    "mseg", "",
    "SELECT s_suppkey AS segment_id, CASE WHEN s_suppkey % 2 = 0 THEN 'FILA ' || (s_suppkey // 25) ELSE 'COLUMNA ' || (s_suppkey % 25) END AS street, s_suppkey % 25 * 105e0 AS ax, s_suppkey // 25 * 105e0 AS ay, s_suppkey % 25 * 105e0 + CASE WHEN s_suppkey % 2 = 0 THEN 100 ELSE 0 END AS qx, s_suppkey // 25 * 105e0 + CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 100 END AS qy FROM supplier",
)


add_cte("segment_ends", "mseg", "SELECT segment_id, street AS own, 's' AS e, ax AS x, ay AS y FROM mseg UNION ALL SELECT segment_id, street, 't', qx, qy FROM mseg")
add_cte(
    "met", "segment_ends",
    f"SELECT p.segment_id, p.e, list_sort(list(DISTINCT m.street)) AS streets, min({_DIST}) AS d FROM segment_ends p JOIN mseg m ON m.street <> p.own AND {_DIST} <= 15 GROUP BY ALL",
)


@query(
    "c18_transversal_streets",
    with_ctes(
        "met",
        "SELECT segment_id, s.streets IS NOT NULL AND NOT (coalesce(s.streets = t.streets, false) AND s.d > t.d) AS corner_start, t.streets IS NOT NULL AND NOT (coalesce(s.streets = t.streets, false) AND s.d <= t.d) AS corner_end"
        " FROM (SELECT * FROM met WHERE e = 's') s FULL JOIN (SELECT * FROM met WHERE e = 't') t USING (segment_id)",
    ),
)
def _c18(spark, sf):
    return curb.corners(_metre_segments(spark, sf))


@query(
    "c19_obstacles_on_segments",
    with_ctes(
        "mseg",
        f"SELECT segment_id, kind, {half_up(_T + ' * 100', 6)} AS position FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'garage' WHEN 1 THEN 'bus_stop' WHEN 2 THEN 'kiosk' ELSE 'loading_bay' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'FILA ' || (c_custkey % 4) END AS name, CAST(c_custkey * 7919 % 2600 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 420 AS DOUBLE) AS y FROM customer) p, mseg"
        f" WHERE (name = '' OR contains(street, name) OR contains(name, street)) AND {_DIST} <= 10",
    ),
)
def _c19(spark, sf):
    return curb.obstacles_on(_metre_segments(spark, sf), _obstacles(spark, sf)).select("segment_id", "kind", up(F.col("position"), 6).alias("position"))


def _lanes(spark, sf):
    s = _metre_segments(spark, sf).withColumn("off", F.when(F.col("street_type") == "AVENIDA", 4.0).otherwise(30.0))
    return s.select(F.transform("line", lambda p: F.struct((p["x"] + 3.0).alias("x"), (p["y"] + F.col("off")).alias("y"))).alias("line"))


# Segments and lanes run along the axes, so their gap is the gap of their boxes.
_GAP = "sqrt(pow(greatest(0, l.ax - s.qx, s.ax - l.qx), 2) + pow(greatest(0, l.ay - s.qy, s.ay - l.qy), 2))"


@query(
    "c20_bike_lane_segments",
    with_ctes(
        "mseg",
        "SELECT DISTINCT s.segment_id FROM mseg s, (SELECT ax + 3 AS ax, ay + off AS ay, qx + 3 AS qx, qy + off AS qy FROM (SELECT *, CASE WHEN segment_id % 11 <> 0 AND segment_id % 5 = 0 THEN 4 ELSE 30 END AS off FROM mseg)) l WHERE " + _GAP + " <= 6",
    ),
)
def _c20(spark, sf):
    return curb.with_bike_lane(_metre_segments(spark, sf), _lanes(spark, sf))


@query("i22_curb_capacity")
def _i22(spark, sf):
    return curb.capacity(_metre_segments(spark, sf), _obstacles(spark, sf), _lanes(spark, sf))


def _grouped(spark, sf):
    """Orders as containers crowded on a few blocks, so that clusters have members."""
    k = F.col("o_orderkey")
    return a.table(spark, sf, "orders").select(
        k.alias("id"), (k % 4).cast("string").alias("group_key"),
        (F.lit(-34.60) + k * 7919 % 1009 * F.lit(0.00011)).alias("latitude"), (F.lit(-58.40) + k * 104729 % 503 * F.lit(0.00013)).alias("longitude"),
        F.concat(F.lit("CALLE LINEA "), k * 31 % 900).alias("address"),
    )


add_cte(
    "grouped", "",
    "SELECT *, longitude * {m} * greatest({least}, cos(radians(avg(latitude) OVER (PARTITION BY group_key)))) AS x, latitude * {m} AS y FROM (SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS VARCHAR) AS group_key, -34.60e0 + o_orderkey * 7919 % 1009 * 11e-5 AS latitude,"
    " -58.40e0 + o_orderkey * 104729 % 503 * 13e-5 AS longitude, o_orderkey * 31 % 900 AS number FROM orders)".format(m=f"{geo.CLUSTER_METRES_PER_DEGREE!r}", least=f"{geo.MIN_LONGITUDE_SCALE!r}"),
)
_NEAR = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= "
add_cte("block_spots", "grouped", "SELECT group_key, latitude, longitude, number, any_value(x) AS x, any_value(y) AS y, min(id) AS node FROM grouped GROUP BY group_key, latitude, longitude, number")
add_cte("block_edges", "block_spots", f"SELECT a.node, b.node AS other FROM block_spots a JOIN block_spots b ON a.group_key = b.group_key AND a.node <> b.node AND abs(a.number - b.number) < 100 AND {_NEAR} 10000")
add_cte("near_spots", "grouped", "SELECT group_key, latitude, longitude, any_value(x) AS x, any_value(y) AS y, min(id) AS node FROM grouped GROUP BY group_key, latitude, longitude")
add_cte("near_lists", "near_spots", f"SELECT a.node, list(b.node) AS nb FROM near_spots a JOIN near_spots b ON a.group_key = b.group_key AND a.node <> b.node AND {_NEAR} 400 GROUP BY a.node")


@query(
    "i19_block_clusters",
    with_ctes("block_edges", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + ",\nreach AS (SELECT node, node AS other FROM block_spots UNION SELECT r.node, e.other FROM reach r JOIN block_edges e ON e.node = r.other)"
    "\nSELECT g.id, l.cluster FROM grouped g JOIN block_spots s ON s.group_key = g.group_key AND s.latitude = g.latitude AND s.longitude = g.longitude AND s.number = g.number JOIN (SELECT node, min(other) AS cluster FROM reach GROUP BY node) l ON l.node = s.node",
)
def _i19(spark, sf):
    return clustering.block_clusters(_grouped(spark, sf))


@query(
    "i20_proximity_clusters",
    with_ctes("near_lists", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    # A step takes every open spot without an open lower neighbour; spots without neighbours are their own.
    + ",\nturns AS (SELECT CAST([] AS BIGINT[]) AS seeds, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT list_concat(any_value(seeds), list(node)), list_concat(any_value(gone), flatten(list(list_append(nb, node))))"
    " FROM (SELECT t.seeds, t.gone, n.node, n.nb FROM turns t, near_lists n WHERE NOT list_contains(t.gone, n.node) AND len(list_filter(n.nb, lambda o: o < n.node AND NOT list_contains(t.gone, o))) = 0) HAVING count(*) > 0),"
    "\nlast AS (SELECT seeds FROM turns ORDER BY len(seeds) DESC LIMIT 1),"
    "\nowned AS (SELECT node, CASE WHEN list_contains(seeds, node) THEN node ELSE list_min(list_filter(nb, lambda o: list_contains(seeds, o))) END AS cluster FROM near_lists, last)"
    "\nSELECT g.id, coalesce(o.cluster, s.node) AS cluster FROM grouped g JOIN near_spots s ON s.group_key = g.group_key AND s.latitude = g.latitude AND s.longitude = g.longitude LEFT JOIN owned o ON o.node = s.node",
)
def _i20(spark, sf):
    return clustering.proximity_clusters(_grouped(spark, sf))


@query(
    "i21_sites_from_clusters",
    with_ctes(
        "active",
        f"SELECT min(id) AS site_id, {half_up('avg(latitude)', 7)} AS latitude, {half_up('avg(longitude)', 7)} AS longitude, count(*) AS containers, 'Sitio RSU - ' || arg_min(address, id) AS name, arg_min(address, id) AS address FROM active GROUP BY site_id",
    ),
)
def _i21(spark, sf):
    c = filters.active(a.containers(spark, sf))
    first = c.groupBy("site_id").agg(F.min("id").alias("cluster"))
    members = c.join(first, "site_id").select(
        "id", "cluster", "latitude", "longitude", "address", F.lit(None).cast("string").alias("type_name"), F.lit("DERECHA").alias("side"), F.lit(1).cast("bigint").alias("waste_type_id")
    )
    sites, _ = clustering.create_sites(members)
    return sites.select("site_id", up(F.col("latitude"), 7).alias("latitude"), up(F.col("longitude"), 7).alias("longitude"), "containers", "name", "address")


def _metadata(spark, sf):
    c = a.containers(spark, sf)
    return c.select(F.col("id").alias("container_id"), F.expr("id div 2 % 25").alias("territory_id"))


add_cte(
    "dominant", "active",
    "SELECT site_id, arg_max(t, (n, -t)) AS territory_id, max(n) AS container_count FROM (SELECT site_id, id // 2 % 25 AS t, count(*) AS n FROM active GROUP BY ALL) GROUP BY site_id",
)


@query("d26_dominant_territory", with_ctes("dominant", "SELECT * FROM dominant"))
def _d26(spark, sf):
    return territory.dominant_territory(a.containers(spark, sf), _metadata(spark, sf))


def _demographics(spark, sf):
    n = a.neighborhoods(spark, sf)
    return territory.demographics(n.select(F.upper("name").alias("barrio"), "population"), n.select("name", "area_km2"))


add_cte(
    "demo", "neighborhoods",
    "SELECT *, " + half_even("greatest(5e-1, least(2e0, 1 + 5e-1 * (d / med - 1)))", 4) + " AS density_factor FROM (SELECT id, name, commune, population, population / area_km2 AS d FROM neighborhoods), (SELECT median(population / area_km2) AS med FROM neighborhoods)",
)


@query("d28_density_factors", with_ctes("demo", f"SELECT name, population, {half_up('d', 6)} AS density_per_km2, density_factor FROM demo"))
def _d28(spark, sf):
    return _demographics(spark, sf).select("name", "population", up(F.col("density_per_km2"), 6).alias("density_per_km2"), "density_factor")


@query(
    "i24_site_features",
    with_ctes(
        "dominant demo",
        "SELECT site_id, k AS feature_key, CASE k WHEN 'territory.commune' THEN CAST(commune AS DOUBLE) WHEN 'demographics.population' THEN CAST(population AS DOUBLE) WHEN 'demand.density_factor' THEN density_factor END AS numeric_value,"
        " CASE k WHEN 'territory.neighborhood' THEN name WHEN 'territory.commune' THEN CAST(commune AS VARCHAR) END AS category_value FROM dominant JOIN demo ON demo.id = territory_id, (VALUES ('territory.neighborhood'), ('territory.commune'), ('demographics.population'), ('demand.density_factor')) v(k)",
    ),
)
def _i24(spark, sf):
    n = a.neighborhoods(spark, sf).select(F.col("id").alias("territory_id"), "name", "commune")
    facts = n.join(_demographics(spark, sf).select("name", "population", "density_per_km2", "density_factor"), "name").withColumnRenamed("name", "neighborhood")
    d = territory.dominant_territory(a.containers(spark, sf), _metadata(spark, sf))
    return territory.site_features(d, facts).where(F.col("feature_key") != "demographics.density_per_km2")
