import random

import pytest
from conftest import hour, rows_of
from pyspark.sql import functions as F

from binflow.plans import scan, whatif

STATE = (
    "container_id bigint, original_site_id bigint, optimized_site_id bigint, level double, last_reading timestamp_ntz,"
    " virtual_updated_at timestamp_ntz, rate_ewma double, overflow_hours double, real_overflow_hours double"
)
READING = "container_id bigint, seq bigint, level_before double, level_after double, reading_date timestamp_ntz, collected boolean"


def state(spark, rows):
    return spark.createDataFrame([(c, o, p, float(v), hour(0), hour(0), None, 0.0, 0.0) for c, o, p, v in rows], STATE)


def run(spark, start, readings, homes=(), **kwargs):
    r = spark.createDataFrame([(c, i, b, a, t, k) for i, (c, b, a, t, k) in enumerate(readings)], READING)
    h = spark.createDataFrame(list(homes), "id bigint, site_id bigint")
    return whatif.replay(start, r, h, **kwargs)


def test_receiver_and_donor_shares(spark):
    s = state(spark, [*[(i, 1, 1, 20) for i in range(5)], (9, 2, 1, 0)])
    got = dict(rows_of(run(spark, s, [(0, 20.0, 32.0, hour(1), False)]), "container_id", "level"))
    assert got[0] == pytest.approx(30) and got[9] == pytest.approx(2) and got[1] == 20
    s = state(spark, [(1, 1, 1, 10), (2, 1, 1, 10), (3, 1, 1, 10), (4, 1, 2, 0), (5, 1, 2, 0)])
    got = dict(rows_of(run(spark, s, [(4, 10.0, 19.0, hour(1), False)]), "container_id", "level"))
    assert [got[c] for c in (1, 2, 3, 4, 5)] == pytest.approx([13, 13, 13, 0, 0])


def replay_by_hand(rows, readings, homes):
    """Sequential replay, one reading after another."""
    cells = {c: dict(o=o, p=p, level=float(v), last=hour(0), upd=hour(0), rate=None, over=0.0, real=0.0) for c, o, p, v in rows}
    for c, before, *_ in readings:
        if c not in cells and c in homes:
            cells[c] = dict(o=homes[c], p=homes[c], level=before or 0.0, last=None, upd=None, rate=None, over=0.0, real=0.0)

    def gap(a, b):
        return 0.0 if a is None else max((b - a).total_seconds() / 3600, 0.0)

    def full(a, b, e):
        return 0.0 if e <= 0 or b < 100 else e if a >= 100 else e * (b - 100) / (b - a)

    def put(cell, t, add=None, value=None):
        e = gap(cell["upd"], t)
        if add is None:
            cell["over"] += e if cell["level"] >= 100 else 0.0
            cell["level"] = min(100.0, max(0.0, value))
        else:
            raw = cell["level"] + add
            cell["over"] += full(cell["level"], raw, e)
            cell["level"] = min(100.0, max(0.0, raw))
        cell["upd"] = t

    for c, before, after, t, picked in sorted(readings, key=lambda r: r[3]):
        if c not in cells:
            continue
        me = cells[c]
        e = gap(me["last"], t)
        made = 0.0 if before is None else after - before
        if before is not None and after >= 99.5 and me["rate"] is not None:
            made = max(made, me["rate"] * e)
        if before is not None and not picked:
            me["real"] += full(before, before + made, e)
        elif before is not None and before >= 99.5:
            me["real"] += e
        if not picked and before is not None and after < 99.5 and e > 0:
            rate = max(after - before, 0.0) / e
            me["rate"] = rate if me["rate"] is None else 0.3 * rate + 0.7 * me["rate"]
        me["last"] = t
        site = me["o"]
        stay = [x for x in cells.values() if x["o"] == x["p"] == site]
        come = [x for x in cells.values() if x["p"] == site != x["o"]]
        if picked:
            if me["o"] == me["p"]:
                put(me, t, value=after)
                for x in come:
                    put(x, t, value=0.0)
        elif me["o"] == me["p"]:
            n = len(stay) + len(come)
            put(me, t, add=made * len(stay) / n)
            for x in come:
                put(x, t, add=made / n)
        else:
            for x in stay:
                put(x, t, add=made / len(stay))
    return cells


@pytest.mark.parametrize("block_hours", [6, 500])
def test_replay_against_sequential(spark, block_hours):
    rng = random.Random(block_hours)
    rows = [(c, c // 3, c // 3 if rng.random() < 0.6 else rng.randrange(4), rng.randrange(100)) for c in range(11)]
    homes = {c: c // 3 for c in range(12)}
    now, readings = {c: float(rng.randrange(90)) for c in range(12)}, []
    for step in range(1, 40):
        for c in rng.sample(range(12), 5):
            before = now[c]
            picked = rng.random() < 0.08
            now[c] = float(rng.randrange(10)) if picked else min(100.0, before + rng.randrange(-3, 18))
            readings.append((c, before, now[c], hour(step + rng.random() / 100), picked))
    got = run(spark, state(spark, rows), readings, homes.items(), block_hours=block_hours).collect()
    want = replay_by_hand(rows, readings, homes)
    assert len(got) == len(want) == 12
    for r in got:
        w = want[r["container_id"]]
        assert (r["last_reading"], r["virtual_updated_at"]) == (w["last"], w["upd"])
        assert [r["level"], r["overflow_hours"], r["real_overflow_hours"]] == pytest.approx([w["level"], w["over"], w["real"]])
        assert r["rate_ewma"] == pytest.approx(w["rate"])


def test_tracking(spark):
    names = ("real_critical_sites", "critical_sites", "real_full_containers", "full_containers")
    rows = [(1, hour(0), 1, 2, 0, 0), (1, hour(0.05), 9, 9, 9, 9), (1, hour(1), 1, 1, 0, 0), (1, hour(2), 5, 5, 0, 0)]
    df = spark.createDataFrame(rows, "plan_id bigint, observed_at timestamp_ntz, " + ", ".join(f"{n} bigint" for n in names))
    kept = whatif.thin_counts(df)
    assert kept.count() == 3
    t = whatif.tracked_totals(kept).first()
    assert t["observed_hours"] == pytest.approx(2)
    assert [t["real_critical_sites_hours"] / 2, t["critical_sites_hours"] / 2] == pytest.approx([1, 1.5])


def test_reset_keeps_distribution(spark):
    got = rows_of(whatif.reset(state(spark, [(1, 1, 2, 55)])), "original_site_id", "optimized_site_id", "level", "last_reading")
    assert got == [(1, 2, 0.0, None)]


def test_scan_takes_its_rows_along(spark):
    """What a row holds goes with it through the scan, pieces and blocks included; nothing is joined by the order columns."""
    rows = [(c, 3 * i + c, i, (i * 7 + c) % 5 - 2.0, f"{c}/{i}") for c in (1, 2) for i in range(75 * c)]
    frame = spark.createDataFrame(rows, "k long, at long, seq long, amount double, said string").withColumn("block", F.expr("at div 100"))
    out = scan.scanned(frame, "k", ("at", "seq"), "block", whatif.LEVELS, whatif.level_function(F.lit(False), F.col("amount")))
    start = F.lit(3.0)
    out = out.select("k", "seq", "said", whatif.LEVELS.after("before", start).alias("b"), whatif.LEVELS.after("until", start).alias("u"))
    want = []
    for c in (1, 2):
        level = 3.0
        for k, _, i, amount, said in rows:
            if k == c:
                want.append((c, i, said, level, min(100.0, max(0.0, level + amount))))
                level = want[-1][4]
    assert sorted(map(tuple, out.collect())) == want
