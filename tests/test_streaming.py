import json
import os
import random
from datetime import datetime

import pytest
from conftest import hour, rows_of
from pyspark.sql import functions as F

from binflow.operators import filters, history, readings
from binflow.plans import whatif
from binflow.queries import streams
from binflow.sources import telemetry
from binflow.streaming import ingest, series, state
from binflow.streaming.whatif import WhatIfFollower, tracked

CONTAINERS = "id bigint, site_id bigint, serie_id string, device_imei string, current_level int, last_reading timestamp_ntz, last_pickup timestamp_ntz, available boolean, change_version bigint, container_type_id bigint, deleted_at timestamp_ntz"


@pytest.fixture
def network(spark):
    rows = [(i, i // 3, f"n|{100 + i}", None, 10, None, None, False, 0, 1, None) for i in range(6)]
    sites = spark.createDataFrame([(0, None), (1, None)], "id bigint, deleted_at timestamp_ntz")
    types = spark.createDataFrame([(1, 3.2)], "id bigint, volume_m3 double")
    return spark.createDataFrame(rows, CONTAINERS), types, sites


def message(c, h, level, picked=False):
    return {"device_id": f"d{c}", "container_id": str(c), "timestamp": hour(h).isoformat(), "telemetry": {"fill_level_pct": float(level)}, "flags": {"is_collection_detected": picked}}


def write_files(folder, files):
    folder.mkdir()
    for i, messages in enumerate(files):
        path = folder / f"part-{i:03d}.json"
        path.write_text("\n".join(json.dumps(m) for m in messages) + "\n")
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)  # the file source reads oldest first


def run_ingest(spark, tmp_path, network, files, hook=None, run=""):
    containers, types, _ = network
    write_files(tmp_path / f"in{run}", files)
    raw = telemetry.read_stream(spark, str(tmp_path / f"in{run}"), files_per_batch=1)
    q = ingest.start(raw, containers, types, str(tmp_path / "history"), str(tmp_path / "states"), str(tmp_path / f"cp{run}"), hook, available_now=True)
    q.awaitTermination(240)
    assert q.exception() is None
    return q


def test_ingest_with_late_data(spark, tmp_path, network):
    files = [[message(1, 1, 20), message(2, 1, 30), message(99, 1, 5)], [message(1, 3, 40), message(1, 2, 90), message(2, 5, 3, True)], [message(1, 2.5, 77)]]
    run_ingest(spark, tmp_path, network, files)
    counts = spark.read.parquet(str(tmp_path / "states" / "counts"))
    assert rows_of(counts, "batch", "received", "updated", "not_found") == [(0, 3, 2, 1), (1, 3, 3, 0), (2, 1, 1, 0)]
    stored = spark.read.parquet(str(tmp_path / "history"))
    assert rows_of(stored, "container_id", "level", "level_old", "accepted") == [
        (1, 20, 10, True), (1, 40, 20, True), (1, 77, 40, False), (1, 90, 40, False), (2, 3, 30, True), (2, 30, 10, True)
    ]
    states = ingest.Snapshots(str(tmp_path / "states" / "states")).at(spark, 2)
    got = rows_of(states.where("container_id in (1, 2, 3)"), "container_id", "current_level", "last_reading", "last_pickup", "available", "change_version")
    assert got == [(1, 40, hour(3), None, True, 3), (2, 3, hour(5), hour(5), True, 4), (3, 10, None, None, False, 0)]
    assert rows_of(ingest.reset_states(states), "current_level", "last_reading")[0] == (0, None)


def test_new_checkpoint_continues(spark, tmp_path, network):
    """A run from a new checkpoint loses neither rows nor states of the runs before it."""
    run_ingest(spark, tmp_path, network, [[message(1, 1, 20)], [message(1, 2, 30), message(2, 1, 5)]])
    run_ingest(spark, tmp_path, network, [[message(1, 1.5, 99), message(2, 3, 50)], [message(1, 4, 60)]], run="b")
    stored = spark.read.parquet(str(tmp_path / "history"))
    assert rows_of(stored, "batch", "container_id", "level", "level_old", "accepted") == [
        (0, 1, 20, 10, True), (1, 1, 30, 20, True), (1, 2, 5, 10, True), (2, 1, 99, 30, False), (2, 2, 50, 5, True), (3, 1, 60, 30, True)
    ]
    states = ingest.Snapshots(str(tmp_path / "states" / "states")).at(spark, 3)
    assert rows_of(states.where("container_id in (1, 2)"), "container_id", "current_level", "last_reading") == [(1, 60, hour(4)), (2, 50, hour(3))]
    ingest.compacted(spark, str(tmp_path / "history"), str(tmp_path / "compact"))
    copy = spark.read.parquet(str(tmp_path / "compact"))
    assert rows_of(copy, *sorted(stored.columns)) == rows_of(stored, *sorted(stored.columns))
    assert len(list((tmp_path / "compact").rglob("*.parquet"))) == stored.select("reading_day").distinct().count()


def test_whatif_follows_ingest(spark, tmp_path, network):
    containers, _, sites = network
    moves = spark.createDataFrame([(5, 0)], "container_id bigint, to_site_id bigint")
    start = whatif.activate(containers, moves)
    hook = WhatIfFollower(1, start, sites, str(tmp_path / "virtual"), str(tmp_path / "counts"))
    rng, level, files = random.Random(1), {c: 10.0 for c in range(6)}, []
    for h in range(1, 4):
        batch = []
        for c in range(6):
            level[c] = min(100.0, level[c] + rng.randrange(30))
            batch.append(message(c, h + c / 100, level[c]))
        files.append(batch)
    run_ingest(spark, tmp_path, network, files, hook)
    got = spark.read.parquet(str(tmp_path / "virtual" / "batch=2"))
    history_rows = spark.read.parquet(str(tmp_path / "history")).withColumn("id", F.monotonically_increasing_id())
    batch_twin = whatif.replay(
        start,
        history_rows.select("container_id", F.col("id").alias("seq"), F.col("level_old").alias("level_before"), F.col("level").alias("level_after"), "reading_date", "collected"),
        containers,
    )
    rounded = ["container_id", F.round("level", 6), F.round("overflow_hours", 6), F.round("rate_ewma", 6), "virtual_updated_at"]
    assert rows_of(got, *rounded) == rows_of(batch_twin, *rounded)
    totals = tracked(spark.read.parquet(str(tmp_path / "counts"))).first()
    assert totals["observed_hours"] == pytest.approx(2)


def test_bucket_stream_and_events(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, i % 2, i % 4, hour(i / 5), float(rng.randrange(100)), rng.random() < 0.1) for i in range(200)]
    schema = "id bigint, site_id bigint, container_id bigint, timestamp timestamp_ntz, level double, collected boolean"
    df = spark.createDataFrame(rows, schema)
    for part in range(4):
        df.where((F.col("id") >= 50 * part) & (F.col("id") < 50 * part + 50)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, cp = str(tmp_path / "buckets"), str(tmp_path / "cp")
    stream = series.bucket_stream(source, 60, "10 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    got = spark.read.parquet(out)
    columns = ("site_id", "timestamp", "level", "measurement_count", "container_count", "collected")
    twin = history.site_buckets(df, 60, carry=0).where(F.col("timestamp") <= got.agg(F.max("timestamp")).first()[0])
    assert got.count() > 30 and rows_of(got, *columns) == rows_of(twin, *columns)

    buckets = spark.readStream.schema(got.schema).parquet(out)
    q = series.collection_events(buckets).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    events = history.with_events(got).where("is_event")
    want = rows_of(events, "site_id", "timestamp", "reason", "drop_points", "is_partial")
    assert rows_of(spark.table("found"), "site_id", F.col("timestamp").cast("timestamp_ntz"), "reason", "drop_points", "is_partial") == want


def test_alarm_stream(spark, tmp_path):
    schema = "timestamp timestamp_ntz, container_id bigint, fill_level_pct double, temperature_c double, battery_pct double, signal_rssi_dbm double, anomaly string"
    t = datetime(2026, 1, 1)
    rows = [(t, 1, 96.0, 80.0, 1.0, 0.0, None), (t, 2, 10.0, 70.0, 9.0, 0.0, None), (t, 3, 1.0, 1.0, 15.0, 0.0, None), (t, 4, 1.0, 1.0, 50.0, -115.0, None), (t, 5, 1.0, 1.0, 50.0, 0.0, "sensor_ruidoso"), (t, 6, 1.0, 1.0, 50.0, 0.0, "incendio")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "m"))
    q = filters.alarms(spark.readStream.schema(schema).parquet(str(tmp_path / "m"))).writeStream.format("memory").queryName("alarms").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows_of(spark.table("alarms"), "container_id", "alarm_type", "severity") == [
        (1, "desborde", "critical"), (2, "incendio", "critical"), (3, "bateria_baja", "warning"), (4, "perdida_senal", "warning"), (5, "sensor_ruidoso", "warning")
    ]


def test_batch_state_twin(spark):
    rows = [(i, i % 3, hour(i * 7 % 11), i, i % 5 == 0) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, container_id bigint, reading_date timestamp_ntz, level int, collected boolean")
    accepted = readings.accepted_readings(df).where("accepted")
    assert rows_of(readings.latest_states(accepted), "container_id", "last_reading") == rows_of(readings.latest_states(df), "container_id", "last_reading")


def test_followed_readings(spark, tmp_path):
    """Keyed state over batches against the batch twin, with late and equal times."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), hour(i / 3 + rng.randrange(-4, 2)), rng.randrange(100), rng.random() < 0.2) for i in range(160)]
    rows += [(200, 1, None, 5, False), (201, None, hour(9), 5, False), (202, 2, hour(500), None, True)]
    df = spark.createDataFrame(rows, "seq bigint, container_id bigint, reading_date timestamp_ntz, level int, collected boolean")
    for part in range(4):
        df.where((F.col("seq") >= 41 * part) & (F.col("seq") < 41 * part + 41)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state.use_disk_state(spark)
    stream = state.followed_readings(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    state.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    newest, want = {}, []
    for seq, c, at, level, picked in rows[:160]:
        old = newest.get(c)
        accepted = old is None or at > old[0]
        want.append((seq, accepted, old and old[1]))
        if accepted:
            newest[c] = (at, level, at if picked else old and old[2])
    assert rows_of(got, "seq", "accepted", "level_old") == want
    assert rows_of(state.latest_of(got), "container_id", "last_reading", "current_level", "last_pickup") == [(c, *newest[c]) for c in sorted(newest)]


def test_event_timers(spark, tmp_path):
    """Buckets of all batches mixed: events of what the watermark has passed, as in the batch series."""
    rng = random.Random(9)
    rows = [(s, hour(h), float(rng.randrange(100)), rng.random() < 0.1) for s in range(3) for h in range(60)]
    df = spark.createDataFrame(rows, "site_id bigint, timestamp timestamp_ntz, level double, collected boolean")
    late = F.unix_micros(F.col("timestamp").cast("timestamp")) / 3_600_000_000 + F.pmod(F.xxhash64("site_id", "timestamp"), F.lit(10))
    low = df.agg(F.min(late)).first()[0]
    for part in range(4):
        df.where((late >= low + 18 * part) & (late < low + 18 * part + 18)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state.use_disk_state(spark)
    stream = state.collection_event_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "10 hours")
    state.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    columns = ("site_id", "timestamp", "previous_level", "drop_points", "reason", "is_partial")
    want = history.with_events(df).where(F.col("is_event") & (F.col("timestamp") <= F.lit(hour(49))))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() > 20 and rows_of(got, *columns) == rows_of(want, *columns)


def test_groups_of_containers(spark, tmp_path):
    """Containers that share a call and its state, over several batches."""
    rng = random.Random(12)
    rows = [(i, rng.randrange(30), hour(i / 9 + rng.randrange(-6, 2)), rng.randrange(100), rng.random() < 0.2) for i in range(600)]
    df = spark.createDataFrame(rows, "seq bigint, container_id bigint, reading_date timestamp_ntz, level int, collected boolean")
    state.use_disk_state(spark)
    source = streams.dealt(df.repartition(3), F.floor(F.col("seq") / 150))
    state.run_available(state.followed_readings(source, groups=2), str(tmp_path / "out"), str(tmp_path / "cp"))
    newest, want = {}, []
    for seq, c, at, level, _ in rows:
        old = newest.get(c)
        want.append((seq, old is None or at > old[0], old and old[1]))
        if want[-1][1]:
            newest[c] = (at, level)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(got, "seq", "accepted", "level_old") == want
    assert len(list((tmp_path / "cp" / "offsets").glob("[0-9]*"))) > 1


def test_groups_of_sites(spark, tmp_path):
    """Sites that share a call, a timer and a state, one of them without a number."""
    rng = random.Random(13)
    rows = [(s or None, hour(h), float(rng.randrange(100)), rng.random() < 0.1) for s in range(12) for h in range(60)]
    df = spark.createDataFrame(rows, "site_id bigint, timestamp timestamp_ntz, level double, collected boolean")
    state.use_disk_state(spark)
    at = F.unix_micros(F.col("timestamp").cast("timestamp")) / 3_600_000_000
    source = streams.dealt(df.repartition(3), F.floor((at - df.agg(F.min(at)).first()[0]) / 15))
    state.run_available(state.collection_event_stream(source, "10 hours", groups=2), str(tmp_path / "out"), str(tmp_path / "cp"))
    columns = ("site_id", "timestamp", "previous_level", "drop_points", "reason", "is_partial")
    want = history.with_events(df).where(F.col("is_event") & (F.col("timestamp") <= F.lit(hour(49))))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() > 60 and sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
