import math
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from binflow.functions import geo, text
from binflow.operators import spatial, territory
from binflow.plans import clustering, curb, demand

LINE = "array<struct<x: double, y: double>>"


def meridian_northing(lat_deg, a=6378137.0, f=1 / 298.257223563):
    """Meridian arc from the equator by numeric integration."""
    e2, steps, top = f * (2 - f), 20000, math.radians(lat_deg)
    h = top / steps
    r = [a * (1 - e2) / (1 - e2 * math.sin(i * h) ** 2) ** 1.5 for i in range(steps + 1)]
    return h * (sum(r) - (r[0] + r[-1]) / 2)


def test_projection(spark):
    df = spark.createDataFrame([(-34.6, -57.0), (-34.6, -58.4)], "lat double, lon double")
    e, n = geo.project(F.col("lat"), F.col("lon"), geo.UTM_21_SOUTH)
    (e0, n0), (e1, n1) = [tuple(r) for r in df.select(e, n).collect()]
    assert e0 == pytest.approx(500000, abs=1e-6)
    assert n0 == pytest.approx(1e7 + 0.9996 * meridian_northing(-34.6), abs=1e-3)
    # Third-order series for the easting, good to centimetres at 1.4 degrees.
    lat, dlon, e2 = math.radians(-34.6), math.radians(-1.4), 0.00669437999014
    nu = 6378137 / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    x, t, c = dlon * math.cos(lat), math.tan(lat) ** 2, e2 / (1 - e2) * math.cos(lat) ** 2
    want = 500000 + 0.9996 * nu * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * e2 / (1 - e2)) * x**5 / 120)
    assert e1 == pytest.approx(want, abs=0.01)
    assert n1 < n0
    _, south = geo.project(F.lit(-34.6), F.lit(-60.0), geo.POSGAR_BELT_5)
    assert df.select(south).first()[0] == pytest.approx(meridian_northing(90) + meridian_northing(-34.6), abs=1e-3)


def test_line_measures(spark):
    line = [(0.0, 0.0), (3.0, 4.0), (3.0, 10.0)]
    df = spark.createDataFrame([(line, 5.0, 7.0)], f"line {LINE}, px double, py double")
    p = geo.interpolate(F.col("line"), F.lit(0.5))
    got = df.select(
        geo.line_length(F.col("line")), geo.line_distance(F.col("px"), F.col("py"), F.col("line")), geo.project_on_line(F.col("px"), F.col("py"), F.col("line")), p["x"], p["y"]
    ).first()
    assert list(got) == pytest.approx([11, 2, 8, 3, 4.5])


def test_wkt(spark):
    df = spark.createDataFrame([("LINESTRING (1 2, 3 4.5, -5e1 6)",), ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",), ("junk",)], "w string")
    got = df.select(geo.line_from_wkt(F.col("w")).alias("l"), geo.polygon_from_wkt(F.col("w")).alias("p")).collect()
    assert [tuple(q) for q in got[0]["l"]] == [(1, 2), (3, 4.5), (-50, 6)] and got[0]["p"] is None
    assert len(got[1]["p"]) == 2 and got[2]["l"] is None and got[2]["p"] is None
    inside = geo.in_polygon(F.col("x"), F.col("y"), F.lit(None).cast(f"array<{LINE}>"))
    assert inside is not None
    points = spark.createDataFrame([(1.5, 1.5), (3.0, 3.0), (5.0, 1.0)], "x double, y double")
    poly = df.where("w like 'POLY%'").select(geo.polygon_from_wkt(F.col("w")).alias("p"))
    hit = points.join(F.broadcast(poly)).select("x", geo.in_polygon(F.col("x"), F.col("y"), F.col("p")).alias("i"))
    assert rows_of(hit) == [(1.5, False), (3.0, True), (5.0, False)]


def test_nearest_however_far(spark):
    rng = random.Random(4)
    points = [(i, rng.random() * 10 ** rng.randrange(0, 4), rng.random() * 50) for i in range(60)]
    targets = [(t, rng.random() * 20, rng.random() * 20) for t in range(15)]
    p = spark.createDataFrame(points, "id bigint, x double, y double")
    t = spark.createDataFrame(targets, "t bigint, tx double, ty double")
    d = F.hypot(F.col("_px") - F.col("tx"), F.col("_py") - F.col("ty"))
    box = (F.col("tx"), F.col("ty"), F.col("tx"), F.col("ty"))
    got = dict(rows_of(spatial.nearest(p, t, "id", (F.col("x"), F.col("y")), box, d, 2.0, ("t",)), "id", "t"))
    assert got == {i: min(targets, key=lambda q: (math.hypot(x - q[1], y - q[2]), q[0]))[0] for i, x, y in points}


def test_salted_grid_join(spark):
    rng = random.Random(8)
    a = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(80)]
    left = spark.createDataFrame(a, "l bigint, lx double, ly double")
    right = spark.createDataFrame(a, "r bigint, rx double, ry double")
    want = sorted((i, j) for i, x, y in a for j, u, v in a if math.hypot(x - u, y - v) <= 0.3)
    for salt in (1, 4):
        pairs = spatial.grid_join(left, right, 0.3, (F.col("lx"), F.col("ly")), (F.col("rx"), F.col("ry")), salt=salt)
        near = pairs.where(F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")) <= 0.3)
        assert rows_of(near, "l", "r") == want


def degrees(x_m, y_m, lat=-34.6, lon=-58.4):
    return lon + x_m / (111320 * math.cos(math.radians(lat))), lat + y_m / 110950


def test_segment_capacity_and_verdict(spark):
    def seg(i, cap, y):
        return (i, cap, [degrees(-50, y), degrees(50, y)])

    segments = spark.createDataFrame([seg(1, 2, 10), seg(2, 5, 20), seg(3, 9, 30), seg(4, 0, 1010), seg(5, 7, 3030)], f"segment_id bigint, capacity int, line {LINE}")
    spots = [(1, 0), (2, 1000), (3, 3000), (4, 6000)]
    sites = spark.createDataFrame([(s, degrees(0, y)[1], degrees(0, y)[0], 3) for s, y in spots] + [(5, None, None, 3)], "site_id bigint, latitude double, longitude double, containers int")
    ruled = territory.segment_capacity(sites, segments)
    assert rows_of(ruled, "site_id", "segment_id", "segment_capacity") == [(1, 2, 5), (2, 4, 0), (3, 5, 7)]
    got = rows_of(territory.capacity_verdict(sites, ruled), "site_id", "max_containers", "may_enter", "free_slots")
    assert got == [(1, 5, True, 2), (2, 3, False, 0), (3, 7, True, 4), (4, 3, False, 0), (5, None, False, 0)]
    assert rows_of(territory.capacity_verdict(sites, None), "max_containers", "may_enter")[0] == (None, True)


def test_shared_tracts(spark):
    def square(x):
        return [[degrees(*p) for p in ((x, 0), (x + 50, 0), (x + 50, 50), (x, 50), (x, 0))]]

    tracts = spark.createDataFrame([("A", square(0)), ("B", square(50))], f"radio_code string, rings array<{LINE}>")
    (lo1, la1), (lo2, la2) = degrees(50, 25), degrees(42, 25)
    bins = spark.createDataFrame([(1, la1, lo1, 1.0), (2, la2, lo2, 1.0)], "id bigint, latitude double, longitude double, volume_m3 double")
    links = territory.buffered_links(tracts, bins, 15.0)
    assert rows_of(links, "radio_code", "container_id") == [("A", 1), ("A", 2), ("B", 1), ("B", 2)]
    people = spark.createDataFrame([("A", 100, "c"), ("B", 100, "c")], "radio_code string, population bigint, department_name string")
    got = {r["container_id"]: r for r in demand.container_demand(demand.allocate(links, people), bins).collect()}
    assert got[1]["daily_waste_kg"] > got[2]["daily_waste_kg"]
    assert got[1]["daily_waste_kg"] + got[2]["daily_waste_kg"] == pytest.approx(300, abs=1e-3)
    assert got[2]["radio_code"] == "A" and got[1]["radio_codes"] == ["A", "B"]


SEGMENT = f"segment_id bigint, street string, line {LINE}, street_type string, side string, general_rule string, specific_rule string"


def test_curb_capacity(spark):
    def seg(i, street, a, b, kind="CALLE", side="DERECHO", rule="", own=""):
        return (i, street, [a, b], kind, side, rule, own)

    far = 1000.0
    rows = [
        seg(1, "UNO", (0.0, 0.0), (100.0, 0.0)),
        seg(2, "CRUCE", (0.0, 5.0), (0.0, 60.0)),
        seg(3, "DOS", (0.0, far), (30.0, far), rule="PROHIBIDO"),
        seg(4, "TRES", (0.0, 2 * far), (30.0, 2 * far), "PASAJE"),
        seg(5, "CUATRO", (0.0, 3 * far), (30.0, 3 * far), side="IZQUIERDO"),
        seg(6, "CINCO", (0.0, 4 * far), (4.0, 4 * far)),
        seg(7, "SEIS", (0.0, 5 * far), (30.0, 5 * far), rule="PROHIBIDO", own="PERMITIDO"),
    ]
    segments = spark.createDataFrame(rows, SEGMENT)
    obstacles = spark.createDataFrame([("garage", "UNO", 50.0, 3.0), ("bus_stop", "OTRA", 60.0, 2.0)], "kind string, street string, x double, y double")
    lanes = spark.createDataFrame([([(0.0, 3 * far + 5), (30.0, 3 * far + 5)],)], f"line {LINE}")
    got = dict(rows_of(curb.capacity(segments, obstacles, lanes)))

    def slots(length, m):
        return max(0, int((length - (2 * m - 0.2)) // 2.07)) if length >= 1.87 + 2 * m else 0

    # Corner blocks 0-10, the garage 45-54; the bus stop belongs to another street.
    assert got[1] == slots(35, 1) + slots(46, 1)
    assert got[3] == slots(30, 6) and got[4] == 0 and got[5] == slots(30, 6) and got[7] == slots(30, 1)
    assert 6 not in got


def test_clusters_against_sequential(spark):
    rng = random.Random(2)
    rows = []
    for i in range(80):
        lon, lat = degrees(rng.randrange(0, 500, 5), rng.randrange(0, 60, 5))
        number = rng.choice([None, 100, 150, 210, 400])
        rows.append((i, "g", lat, lon, None if number is None else f"LINEA NORTE {number}"))
    df = spark.createDataFrame(rows, "id bigint, group_key string, latitude double, longitude double, address string")
    mean = sum(r[2] for r in rows) / len(rows)
    per_lon = 111320 * math.cos(math.radians(mean))

    def near(a, b, m):
        return ((a[2] - b[2]) * 111320) ** 2 + ((a[3] - b[3]) * per_lon) ** 2 <= m * m

    taken, want = {}, {}
    for a in rows:
        if a[0] not in taken:
            for b in rows:
                if b[0] not in taken and (a[0] == b[0] or near(a, b, 20)):
                    taken[b[0]] = a[0]
    assert dict(rows_of(clustering.proximity_clusters(df))) == taken

    def number(r):
        return int(r[4].split()[-1]) if r[4] else None

    for a in rows:
        if a[0] in want:
            continue
        queue, members = [a], {a[0]}
        while queue:
            c = queue.pop()
            for b in rows:
                linked = number(c) is None or number(b) is None or abs(number(c) - number(b)) < 100
                if b[0] not in members and near(c, b, 100) and linked:
                    members.add(b[0])
                    queue.append(b)
        for m in members:
            want[m] = min(members)
    assert dict(rows_of(clustering.block_clusters(df))) == want


def test_addresses(spark):
    cases = {
        "AV. CORRIENTES 1234": ("CORRIENTES", 1234), "CORRIENTES AV. 1235": ("CORRIENTES", 1235),
        "Sitio RSU - CALLAO 520": ("CALLAO", 520), "SAN MARTIN 450": ("SAN MARTIN", 450), "SIN NUMERO": None,
        "Cabo 2º 300": ("CABO", 2),
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string").select("a", text.parse_address(F.col("a")).alias("p"))
    assert {r["a"]: None if r["p"] is None else tuple(r["p"]) for r in df.collect()} == cases


def test_order_statistics(spark):
    rng = random.Random(1)
    values = [round(rng.expovariate(0.3), 3) for _ in range(257)] + [2.0] * 100
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = demand.order_statistics(df, "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).first()
    s = sorted(values)
    assert list(row) == [s[int(len(s) * p)] for p in (0.5, 0.9, 0.99)]


def test_long_chain_of_containers(spark):
    """Containers numbered along a street: every second one starts a cluster, whether a task walks them or rounds do."""
    rows = [(i, "g", 0.0, i * 15 / 111320.0) for i in range(1500)] + [(5000, "g", 0.5, 0.5), (5001, "h", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id bigint, group_key string, latitude double, longitude double")
    want = {i: i - i % 2 for i in range(1500)} | {5000: 5000, 5001: 5001}
    assert dict(rows_of(clustering.proximity_clusters(df))) == want
    few = df.where("id < 12")
    assert dict(rows_of(clustering.proximity_clusters(few, component_edges=4))) == {i: want[i] for i in range(12)}


def test_distance_join_with_polar_rows(spark):
    """Rows at the poles and elsewhere: every pair within reach, and cells of their own away from the poles."""
    rng = random.Random(4)
    places = [(90.0, 10.0), (89.999, -170.0), (-90.0, 0.0)]
    places += [(60 + rng.uniform(0, 0.1), rng.uniform(0, 0.2)) for _ in range(60)] + [(rng.uniform(-0.05, 0.05), rng.uniform(0, 0.1)) for _ in range(60)]
    left = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(places)], "donor_id bigint, donor_latitude double, donor_longitude double")
    right = left.toDF("receiver_id", "receiver_latitude", "receiver_longitude")

    def km(p, q):
        a, b, c, d = map(math.radians, (*p, *q))
        return 2 * 6371 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    want = sorted((i, j) for i, p in enumerate(places) for j, q in enumerate(places) if km(p, q) <= 1.5)
    assert rows_of(spatial.haversine_pairs(left, right, 1.5), "donor_id", "receiver_id") == want


PLACED = "id bigint, group_key string, latitude double, longitude double, address string"


def chained(rows):
    """(id, cluster) of each row by its definition: spots of one group tied in pairs, those of one name tied, too."""
    means = {g: sum(r[2] for r in rows if r[1] == g and r[2] is not None) / max(1, sum(r[1] == g and r[2] is not None for r in rows)) for g in {r[1] for r in rows}}
    number = lambda r: int(r[4].split()[-1]) if r[4] else None
    spots = {}
    for r in rows:
        key = (r[1], r[2], r[3], number(r))
        spots[key] = min((i for i in (spots.get(key), r[0]) if i is not None), default=None)
    label = {n: n for n in spots.values() if n is not None}

    def linked(a, b):
        (g, y, x, n), (h, v, u, m) = a, b
        if g is None or g != h or None in (y, x, v, u):
            return False
        per_lon = 111320 * math.cos(math.radians(means[g]))
        return ((y - v) * 111320) ** 2 + ((x - u) * per_lon) ** 2 <= 1e4 and (n is None or m is None or abs(n - m) < 100)

    ties = [(p, q) for a, p in spots.items() for b, q in spots.items() if p is not None and q is not None and p < q and linked(a, b)]
    changed = True
    while changed:
        changed = False
        for p, q in ties:
            low = min(label[p], label[q])
            changed |= label[p] != low or label[q] != low
            label[p] = label[q] = low
    names = list(spots.values())
    out = []
    for r in rows:
        n = spots[r[1], r[2], r[3], number(r)]
        out += [(r[0], label[n])] * names.count(n) if n is not None else []
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [4096, 1])
def test_block_clusters_of_crowds(spark, monkeypatch, at_once):
    """Crowds 60 to 130 m apart, in place and in house numbers, with and without a spot between them."""
    monkeypatch.setattr(clustering, "PAIR_TESTS", at_once)
    rng = random.Random(7)
    rows = []
    for x, numbers in ((0, (0, 40)), (60, (130, 170)), (170, (100, 160)), (290, (190, 240)), (420, (100, 340)), (600, (0, 5))):
        for _ in range(15):
            lon, lat = degrees(x + rng.uniform(0, 30), rng.uniform(0, 60))
            rows.append((len(rows), rng.choice("gh"), lat, lon, f"LINEA NORTE {rng.randrange(*numbers)}"))
    lon, lat = degrees(520, 30)
    rows += [(len(rows), "g", lat, lon, None), (len(rows) + 1, None, lat, lon, None), (len(rows) + 2, "g", None, lon, None), (len(rows) + 3, "g", None, lon, None)]
    assert sorted(rows_of(clustering.block_clusters(spark.createDataFrame(rows, PLACED))), key=str) == chained(rows)


def test_block_clusters_of_repeated_and_unknown_ids(spark):
    places = [degrees(x, 0) for x in (0, 80, 400, 480, 900)]
    ids = [(1, 0), (2, 1), (3, 2), (4, 3), (2, 4), (None, 0), (None, 3), (7, 3), (5, 0), (5, 0)]
    rows = [(i, "g", places[k][1], places[k][0], None) for i, k in ids]
    rows += [(None, "g", *degrees(240, 0)[::-1], None), (None, "g", *degrees(320, 0)[::-1], None)]
    assert sorted(rows_of(clustering.block_clusters(spark.createDataFrame(rows, PLACED))), key=str) == chained(rows)


def test_block_clusters_list_no_pairs(spark, monkeypatch):
    """400 containers in one crowd and 400 in another are joined by few edges, not by those of all pairs."""
    seen = []

    def counted(nodes, edges, real=clustering.connected):
        seen.append(edges.count())
        return real(nodes, edges)

    monkeypatch.setattr(clustering, "connected", counted)
    spots = [degrees(x + i % 20, i // 20) for x in (0, 160) for i in range(400)]
    rows = [(i, "g", lat, lon, "LINEA NORTE 100") for i, (lon, lat) in enumerate(spots)]
    assert set(rows_of(clustering.block_clusters(spark.createDataFrame(rows, PLACED)))) == {(i, i // 400 * 400) for i in range(800)}
    assert sum(seen) <= 800


SEGMENTS = "route_id string, route_rank bigint, segment bigint, street_name string, alt_start bigint, alt_end bigint"
SITES = "site_id bigint, name string, address string, latitude double, longitude double"


def test_routes_by_ranges_of_numbers(spark):
    """The first segment in file order whose range holds the number, for ranges of any length and order of ends."""
    rng = random.Random(3)
    segments = [(f"R{i % 9}", i % 9, i, f"LINEA {rng.choice(['NORTE', 'SUR'])}", rng.randrange(0, 99999), 0) for i in range(150)]
    segments = [(*s[:5], max(0, s[4] + rng.choice([-1, 1]) * rng.choice([0, 2, 100, 3000, 60000]))) for s in segments]
    segments += [("R3", 3, 900, "LINEA NORTE", None, None), ("R0", 0, 901, "LINEA SUR", None, 70), ("R10", 10, 902, "LINEA SUR", 99990, 10**12)]
    numbers = [0, 1, 49, 50, 51, 120, 121, 99998, 99999] + [rng.randrange(100000) for _ in range(120)] + [s[4] + d for s in segments[:20] for d in (-51, -50, 50, 51) if s[4] + d >= 0]
    sites = [(i, "", f"LINEA {('NORTE', 'SUR')[i % 2]} {n}", -34.6, -58.4) for i, n in enumerate(numbers) if n < 100000]
    want = []
    for i, _, address, _, _ in sites:
        street, n = address.rsplit(" ", 1)
        ends = lambda s: [e for e in s[4:] if e is not None]
        mine = sorted((s for s in segments if s[3] == street), key=lambda s: s[1:3])
        held = [s for s in mine if ends(s) and min(ends(s)) - 50 <= int(n) <= max(ends(s)) + 50]
        want.append((i, (held or mine)[0][0], (held or mine)[0][2]))
    fallback = spark.createDataFrame([], "route_id string, latitude double, longitude double")
    got = territory.assign_routes(spark.createDataFrame(sites, SITES), spark.createDataFrame(segments, SEGMENTS), fallback)
    assert rows_of(got) == sorted(want)


def test_routes_with_one_centre_count_once(spark, monkeypatch):
    """2,500 routes without sites share a centre: one of them, the lowest, is compared with each site."""
    searched = []
    monkeypatch.setattr(territory, "_nearest_centre", lambda sites, centres, *_: searched.append(1) or sites.select("site_id", F.lit(None).cast("string").alias("route_id")))
    fallback = spark.createDataFrame([(f"R{i}", -34.6402, -58.4101) for i in range(2500)] + [("Q", -34.5, -58.4), ("S", 0.0, 0.0)], "route_id string, latitude double, longitude double")
    sites = [(1, "", "OTRA 5", -34.65, -58.41), (2, "", None, -34.49, -58.4), (2, "", None, -34.49, -58.4), (3, "", "OTRA 7", 0.0, 0.0), (4, "", "OTRA 7", None, 1.0), (5, "", "OTRA 7", 1.0, 1.0)]
    none = spark.createDataFrame([], SEGMENTS)
    got = rows_of(territory.assign_routes(spark.createDataFrame(sites, SITES), none, fallback))
    assert got == [(1, "R0", 10**9), (2, "Q", 10**9), (2, "Q", 10**9), (5, "S", 10**9)] and not searched


def test_nearest_of_few_agrees_with_each_distance(spark):
    rng = random.Random(9)
    places = [(rng.randrange(40) / 10, rng.randrange(40) / 10) for _ in range(300)]
    centres = [(f"R{i}", rng.randrange(40) / 10, rng.randrange(40) / 10) for i in range(60)]
    sites = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(900, None, 1.0)], "site_id bigint, latitude double, longitude double")
    cs = spark.createDataFrame(centres, "route_id string, clat double, clon double")
    every = sites.crossJoin(cs).select("site_id", F.struct(territory._away(F.col("latitude"), F.col("longitude"), F.col("clat"), F.col("clon")), "route_id").alias("d"))
    want = rows_of(every.where("site_id < 900").groupBy("site_id").agg(F.min("d")["route_id"].alias("r")))
    assert rows_of(territory._nearest_of_few(sites, cs)) == want
    assert {r for _, r in rows_of(territory._nearest_of_few(sites, cs.limit(0)))} == {None}
