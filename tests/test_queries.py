"""Registered queries against DuckDB on the smallest tables, and the driver contract."""

import importlib.util
import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(ROOT / "tools"))

from binflow.queries import ORACLES, QUERIES, load  # noqa: E402
from check_queries import TABLES, rows_of  # noqa: E402

load()
# ALL_QUERIES=1 holds every query against its check; without it, one or two of each family.
SAMPLE = tuple(ORACLES) if os.environ.get("ALL_QUERIES") else (
    "a12_zone_profile_layer", "c11_segment_capacity", "c13_largest_overlap", "e08_feed_pages", "e08_site_feed", "i12_overload_greedy_plan", "i13_marginal_curves",
    "i15_assigned_moves", "i16_merged_moves", "i23_capacity_verdict",
    "b07_alarms", "c05_as_of_join", "c07_distance_join", "c09_point_in_polygon", "d01_network_kpis", "d05_site_utilisation", "d10_site_buckets",
    "d21_overload_hours", "d24_container_demand", "e02_collection_cycles", "e07_accepted_readings", "i01_baseline_forecast", "i28_route_schedule",
    "e11_thinned_counts", "e12_fill_rate_ewma", "e15_cumulative_levels", "s02_late_reading_stream", "s03_latest_state_stream", "s04_bucket_stream", "s05_alarm_stream", "s06_collection_event_stream", "s07_whatif_replay",
)


@pytest.fixture(scope="module")
def db():
    if not Path(SF).exists():
        pytest.skip("benchmark tables not present")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, db, name):
    frame = QUERIES[name](spark, SF)
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.collect(), frame.columns) == rows_of(result.fetchall(), columns)


def test_contract(spark):
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries())
    if Path(SF).exists():
        assert module.entry(spark).count() == 1
