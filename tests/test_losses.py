"""Nothing is lost: change feed pages, ids, nearest targets, overlaps, gains, day files."""

import math
import random

import pytest
from pyspark.sql import functions as F

from binflow.operators import network, readings as arrivals, spatial, territory
from binflow.plans import overload
from binflow.session import numbered_by
from binflow.sources import facts, telemetry
from binflow.streaming import ingest
from conftest import hour, rows_of

LINE = "array<struct<x: double, y: double>>"
STATE = "container_id bigint, site_id bigint, current_level int, last_reading timestamp_ntz, last_pickup timestamp_ntz, available boolean, change_version bigint"


def test_feed_pages_see_every_change(spark):
    states = spark.createDataFrame([(i, i // 2, 0, None, None, True, 900 + i % 3) for i in range(20)], STATE)
    batch = spark.createDataFrame(
        [(i, c, 40 + c, hour(1), False) for i, c in enumerate([3, 17, 4, 9, 0, 11, 5, 14, 2, 19, 7, 6, 13, 8, 99])], "id bigint, container_id bigint, level int, reading_date timestamp_ntz, collected boolean"
    )
    after = ingest.merge_states(states, batch)
    versions = dict(rows_of(after, "container_id", "change_version"))
    changed = [c for c, v in versions.items() if v > 902]
    assert sorted(changed) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 14, 17, 19]
    assert sorted(versions[c] for c in changed) == list(range(903, 917))
    table = after.withColumnRenamed("container_id", "id").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    for feed in (table, table.withColumn("change_version", F.when(F.col("change_version") > 902, 903).otherwise(F.col("change_version")))):
        seen, cursor, last = [], 902, None
        for _ in range(6):
            page, state = network.changes(feed, cursor, 4, last)
            seen += [r.id for r in page.collect()]
            state = state.first()
            cursor, last = state.cursor, state.cursor_id
        assert sorted(seen) == sorted(changed)
        sites = spark.createDataFrame([(i, None) for i in range(10)], "id bigint, deleted_at timestamp_ntz")
        page, state = network.site_changes(sites, feed, 902, 100)
        assert {r.id for r in page.collect()} == {c // 2 for c in changed} and not state.first().has_more


def test_dense_numbers(spark):
    rows = [(i * 7919 % 500,) for i in range(500)]
    got = rows_of(numbered_by(spark.createDataFrame(rows, "v int").repartition(7), ["v"], "n"), "v", "n")
    assert got == [(i, i) for i in range(500)]
    messages = spark.createDataFrame(rows, "position int")
    ids = [sorted(r[0] for r in rows_of(telemetry.numbered(messages, b), "id")) for b in (0, 1)]
    assert ids[0] == list(range(500)) and ids[1] == [telemetry.BATCH_IDS + i for i in range(500)]
    with pytest.raises(ValueError):
        telemetry.numbered(messages, 2**23)


def test_nearest_loses_no_point(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 1e6, 0.0), (4, float("nan"), 0.0)], "id bigint, x double, y double")
    targets = spark.createDataFrame([(7, 1.0, 1.0), (8, None, 2.0)], "t bigint, tx double, ty double")
    d = F.hypot(F.col("_px") - F.col("tx"), F.col("_py") - F.col("ty"))
    box = (F.col("tx"), F.col("ty"), F.col("tx"), F.col("ty"))
    find = lambda t: rows_of(spatial.nearest(points, t, "id", (F.col("x"), F.col("y")), box, d, 0.5, ("t",)), "id", "t")
    assert find(targets) == [(1, 7), (2, None), (3, 7), (4, None)]
    assert find(targets.limit(0)) == [(i, None) for i in (1, 2, 3, 4)]


def square(x, y, s):
    x, y, s = float(x), float(y), float(s)
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def test_exact_overlap(spark):
    rng = random.Random(3)
    polygons = [(1, [square(0, 0, 10)]), (2, [square(10, 0, 10)]), (3, [square(0, 10, 4), square(1, 11, 1)[::-1]])]
    # A sliver no lattice would meet, a tract mostly in 2, one in a hole, one outside.
    tracts = [("v", [[(1.0, 1.0), (9.0, 1.00001), (1.0, 1.00002), (5.0, 1.00001), (1.0, 1.0)]]), ("b", [square(8, 2, 6)]), ("h", [square(1.1, 11.1, 0.5)]), ("o", [square(50, 50, 1)])]
    frames = [spark.createDataFrame(rows, f"{key}, rings array<{LINE}>") for rows, key in ((tracts, "radio_code string"), (polygons, "polygon_id bigint"))]
    assert rows_of(territory.largest_overlap(*frames, 3.0), "radio_code", "polygon_id") == [("b", 2), ("v", 1)]
    for _ in range(5):
        a, b = (square(rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(1, 4)) for _ in range(2))
        turn = rng.uniform(0, 6)
        spin = lambda r, t=turn: [(x * math.cos(t) - y * math.sin(t), x * math.sin(t) + y * math.cos(t)) for x, y in r]
        width = max(0, min(a[1][0], b[1][0]) - max(a[0][0], b[0][0]))
        height = max(0, min(a[2][1], b[2][1]) - max(a[0][1], b[0][1]))
        row = spark.createDataFrame([([spin(a)], [spin(b)])], f"a array<{LINE}>, b array<{LINE}>")
        area = territory.overlap_area(territory._edges(F.col("a"), F.lit(-20.0)), territory._edges(F.col("b"), F.lit(-20.0)))
        assert row.select(area).first()[0] == pytest.approx(width * height, abs=1e-9)


def test_gains_have_no_cap(spark):
    curves = spark.createDataFrame([(1, 2, [float(100 - i) for i in range(60)])], "site_id bigint, now bigint, costs array<double>")
    limits = spark.createDataFrame([(1, None)], "site_id bigint, max_containers int")
    assert len(overload.marginal_curves(curves, limits).first().gains) == 58


@pytest.mark.parametrize("increasing", [True, False])
def test_pooling_against_min_max(spark, increasing):
    rng = random.Random(2)
    cases = [[], [3.0], *[[rng.choice([0.0, 1.0, 2.5, rng.random() * 5]) for _ in range(rng.randint(1, 9))] for _ in range(25)]]
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, v array<double>")
    got = dict(rows_of(rows.select("id", overload.isotonic(F.col("v"), increasing).alias("f")), "id", "f"))
    inner, outer = (min, max) if increasing else (max, min)
    for i, v in enumerate(cases):
        mean = lambda a, b, v=v: sum(v[a : b + 1]) / (b - a + 1)
        want = [outer(inner(mean(a, b) for b in range(k, len(v))) for a in range(k + 1)) for k in range(len(v))]
        assert got[i] == pytest.approx(want)


def test_large_site_ids(spark):
    rows = spark.createDataFrame([(9 * 10**18,), (9 * 10**9,), (5,)], "k bigint")
    assert rows.select(arrivals.seeded_order(F.col("k"), 7)).count() == 3 and None not in {r[0] for r in rows.select(arrivals.seeded_order(F.col("k"), 7)).collect()}
    assert rows.where("k = 5").select(arrivals.seeded_order(F.col("k"), 7)).first()[0] == (5 * 1103515245 + 7 * 12345 + 1013904223) % 2**31


def test_crowded_day_is_split(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 12).select("id", F.col("id").alias("container_id"), F.expr("timestamp_ntz'2024-01-05 00:00:00' + make_interval(0, 0, 0, cast(id % 50000 = 0 as int) * 2)").alias("reading_date"), F.sha2(F.col("id").cast("string"), 256).alias("note"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        facts.write_readings(rows, str(tmp_path / "h"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = {d.name: len(list(d.glob("part-*.parquet"))) for d in (tmp_path / "h").glob("reading_day=*")}
    assert files["reading_day=2024-01-05"] > 4 and files["reading_day=2024-01-07"] == 1
    assert spark.read.parquet(str(tmp_path / "h")).count() == 200_000
