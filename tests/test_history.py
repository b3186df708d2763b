import random
from datetime import datetime, timedelta

import pytest
from conftest import T0, hour, rows_of
from pyspark.sql import functions as F

from binflow.functions import times
from binflow.operators import history, readings

SAMPLE = "id bigint, site_id bigint, container_id bigint, timestamp timestamp_ntz, level double, collected boolean"
BUCKET = "site_id bigint, timestamp timestamp_ntz, level double, collected boolean"


def at(text):
    return datetime.fromisoformat(f"2026-01-01 {text}")


def samples(spark, rows):
    return spark.createDataFrame([(i, 1, c, t, float(v), s) for i, (c, t, v, s) in enumerate(rows)], SAMPLE)


def buckets(spark, levels, signals=()):
    return spark.createDataFrame([(1, hour(i), float(v), i in signals) for i, v in enumerate(levels)], BUCKET)


def test_grid(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1, 8, 47, 30),)], "t timestamp_ntz")
    got = df.select(
        times.floor_to_interval(F.col("t"), 60), times.floor_to_interval(F.col("t"), 15), times.ceil_to_next_interval(F.col("t"), 60)
    ).first()
    assert list(got) == [at("08:00"), at("08:45"), at("09:00")]


def test_carry_forward(spark):
    s = samples(spark, [(10, at("08:05"), 20, False), (11, at("08:55"), 40, True), (10, at("09:01"), 50, False)])
    got = rows_of(history.site_buckets(s), "timestamp", "level", "measurement_count", "container_count", "collected")
    assert got == [(at("08:00"), 30.0, 2, 2, True), (at("09:00"), 45.0, 1, 2, False)]


def test_staggered_and_expiry(spark):
    s = samples(spark, [(10, hour(7), 80, False), (11, hour(7), 20, False), (10, hour(8), 82, False), (11, hour(9), 22, False), (10, hour(10), 84, False)])
    assert [r[1] for r in rows_of(history.site_buckets(s), "timestamp", "level")] == [50, 51, 52, 53]
    s = samples(spark, [(10, hour(7), 80, False), (11, hour(7), 20, False), (10, hour(10), 80, False), (10, hour(11), 80, False)])
    assert [r[1:] for r in rows_of(history.site_buckets(s), "timestamp", "level", "container_count")] == [(50, 2), (50, 2), (80, 1)]


def carry_by_hand(rows, interval, carry):
    """Sequential last-known-level series of one site."""
    grid = {}
    for c, t, v, s in sorted(rows, key=lambda r: r[1]):
        minute = t.hour * 60 + t.minute
        stamp = datetime(t.year, t.month, t.day) + timedelta(minutes=minute - minute % interval)
        grid.setdefault(stamp, []).append((c, v))
    known, out = {}, []
    for stamp in sorted(grid):
        for c, v in grid[stamp]:
            known[c] = (stamp, v)
        live = [v for m, v in known.values() if stamp - m <= timedelta(minutes=carry)]
        out.append((stamp, sum(live) / len(live), len(grid[stamp]), len(live)))
    return out


@pytest.mark.parametrize("interval,carry", [(60, 180), (50, 170), (7, 20)])
def test_buckets_against_sequential(spark, interval, carry):
    rng = random.Random(interval)
    rows = [(rng.randrange(4), T0 + timedelta(minutes=rng.randrange(3 * 1440), seconds=i), rng.randrange(101), False) for i in range(300)]
    got = rows_of(history.site_buckets(samples(spark, rows), interval, carry=carry), "timestamp", "level", "measurement_count", "container_count")
    want = carry_by_hand(rows, interval, carry)
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want]
    assert all(abs(g[1] - w[1]) <= 0.0051 for g, w in zip(got, want))


def test_generation(spark):
    g = history.generation(buckets(spark, [10, 13, 16, 2, 5, 8]))
    assert [r[1] for r in rows_of(g, "timestamp", "generation")] == [0, 3, 3, 3, 3, 3]
    g = history.generation(buckets(spark, [10, 12, 14, 30, 32], {3}))
    assert [r[1] for r in rows_of(g, "timestamp", "generation")] == [0, 2, 2, 2, 2]


def test_uncollected_and_crossing(spark):
    b = buckets(spark, [0, 10, 20, 30, 40, 50, 60, 70, 5, 15, 25], {8}).withColumn("observed", F.col("timestamp") > F.lit(hour(5)))
    u = history.uncollected_levels(b)
    assert [r[1] for r in rows_of(u, "timestamp", "uncollected")] == [60, 70, 80, 90, 100]
    assert history.first_crossing(u, 80.0).first()["crossed_at"] == hour(8)


def test_cycles(spark):
    c = history.collection_cycles(buckets(spark, [30, 55, 80, 20, 35]))
    got = rows_of(c, "cycle", "started_at", "ended_at", "start_level", "end_level", "bucket_count", "reason")
    assert got == [(0, hour(0), hour(3), 30.0, 20.0, 4, "level_drop"), (1, hour(3), None, 20.0, 35.0, 2, None)]
    first = history.collection_cycles(buckets(spark, [5, 9], {0}))
    assert rows_of(first, "cycle", "bucket_count", "ended_at") == [(0, 1, hour(0)), (1, 2, None)]


def test_partial_events(spark):
    e = history.with_events(buckets(spark, [50, 40, 10, 5]))
    assert rows_of(e, "timestamp", "is_event", "is_partial") == [
        (hour(0), False, False), (hour(1), True, True), (hour(2), True, False), (hour(3), False, False)
    ]


def accepted_by_hand(rows, states=None):
    newest, level, out = dict(states or {}), {}, []
    for seq, c, t, v in sorted(rows):
        last = newest.get(c)
        ok = last is None or t > last[0]
        out.append((seq, ok, None if last is None else last[1]))
        if ok:
            newest[c] = (t, v)
    return out


@pytest.mark.parametrize("block", [5, 1000])
def test_accepted_readings(spark, block):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 2]), hour(rng.randrange(40)), rng.randrange(100)) for i in range(200)]
    df = spark.createDataFrame([(*r, False) for r in rows], "id bigint, container_id bigint, reading_date timestamp_ntz, level int, collected boolean")
    assert rows_of(readings.accepted_readings(df, block_rows=block), "id", "accepted", "level_old") == sorted(accepted_by_hand(rows))
    states = spark.createDataFrame([(1, 7, hour(20)), (2, 9, None)], "container_id bigint, current_level int, last_reading timestamp_ntz")
    got = rows_of(readings.accepted_readings(df, block_rows=block, states=states), "id", "accepted", "level_old")
    want = accepted_by_hand(rows, {1: (hour(20), 7), 2: (datetime(1900, 1, 1), 9)})
    assert got == sorted(want)


def test_retention(spark):
    df = spark.createDataFrame([(i, i % 2, hour(12 * i)) for i in range(10)], "id bigint, container_id bigint, reading_date timestamp_ntz")
    cut = readings.retention_cut(df, 2, 3)
    assert cut.first()[0] == 3
    assert readings.retained(df, cut).count() == 6
    assert [r[1] for r in rows_of(readings.days_to_drop(df, cut), "reading_day", "readings")] == [2, 2]
    assert readings.retention_cut(df, 2, 5).first()[0] is None
