import json
from datetime import date, datetime

import pytest
from conftest import hour, rows_of
from pyspark.sql import functions as F

from binflow.functions import times
from binflow.operators import network
from binflow.sources import facts, geojson, tables, telemetry


def test_telemetry_defaults(spark, tmp_path):
    one = {"device_id": "d1", "container_id": "x|7", "timestamp": "2026-01-01T08:00:00+00:00", "telemetry": {"fill_level_pct": 41.5}, "flags": {}}
    batch = {"measurements": [one, {"device_id": "d2", "container_id": "9", "timestamp": "soon", "telemetry": {"battery_pct": 5.0, "acceleration_g": 3.0}, "flags": {"is_collection_detected": True, "anomaly": "incendio"}}]}
    (tmp_path / "m.json").write_text(json.dumps(one) + "\n" + json.dumps(batch) + "\n")
    now = F.lit(hour(0)).cast(times.NTZ)
    flat = telemetry.normalise(telemetry.read(spark, str(tmp_path)), now)
    got = rows_of(flat, "raw_container_id", "reading_date", "fill_level_pct", "battery_pct", "acceleration_g", "collected", "anomaly")
    eight = datetime(2026, 1, 1, 8)
    assert got == [("9", hour(0), 0.0, 5.0, 3.0, True, "incendio"), ("x|7", eight, 41.5, 100.0, 1.0, False, None), ("x|7", eight, 41.5, 100.0, 1.0, False, None)]


def test_identity_order_and_collisions(spark):
    known = spark.createDataFrame([(1, "red|50", "im1"), (2, "blue|50", None), (50, "z|1", None), (60, "whole", "im9")], "id bigint, serie_id string, device_imei string")
    t = spark.createDataFrame([("a|1", "q"), ("50", "q"), ("red|51", "im1"), ("whole", "q"), ("blue|x", "q"), (None, "im9")], "raw_container_id string, device_id string")
    got = {r["raw_container_id"]: r["container_id"] for r in network.resolve_identity(t, known).collect()}
    assert got == {"a|1": 1, "50": 50, "red|51": 1, "whole": 60, "blue|x": None, None: 60}
    tie = spark.createDataFrame([("n|50", "q")], "raw_container_id string, device_id string")
    assert network.resolve_identity(tie, known.where("id < 50")).first()["container_id"] == 2


def feature(pid=None, fid=None, coordinates=(-58.4, -34.6), **props):
    return {"type": "Feature", "id": fid, "properties": {"Id": pid, **props}, "geometry": {"type": "Point", "coordinates": list(coordinates)}}


@pytest.mark.parametrize("lines", [False, True])
def test_container_features(spark, tmp_path, lines):
    features = [
        feature("1", CodEquipa="BILATERAL"), feature(None, "2", CodEquipa="soterrado"), feature("1"), feature(), feature("3", coordinates=()), feature("green|9"),
    ]
    path = tmp_path / "contenedores_negros.json"
    text = "\n".join(json.dumps(f) for f in features) if lines else json.dumps({"type": "FeatureCollection", "features": features}, indent=1)
    path.write_text(text)
    known = spark.createDataFrame([("green|9",)], "serie_id string")
    rows = geojson.container_features(spark, str(path), "negros", "Húmedo", known, lines)
    assert dict(rows_of(geojson.import_counts(rows))) == {"success": 2, "no_id": 1, "duplicate": 2, "bad_geom": 1}
    assert rows_of(rows.where("status = 'success'"), "serie_id", "container_type", "latitude") == [
        ("negros|1", "Bilateral Fracción Húmeda", -34.6), ("negros|2", "Soterrado Fracción Húmeda", -34.6)
    ]


def test_street_features(spark, tmp_path):
    def street(kind, coordinates, **props):
        return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coordinates}}

    features = [
        street("LineString", [[0, 0], [1, 1]], nomoficial=" Mitre ", sentido="creciente", tipo_c="Avenida"),
        street("LineString", [[0, 0], [1, 2]], nom_mapa="Alem"),
        street("MultiLineString", [[[0, 0], [1, 1]]], nomoficial="x"),
        street("LineString", [[0, 0]], nomoficial="y"),
    ]
    (tmp_path / "calles.json").write_text(json.dumps({"features": features}))
    got = rows_of(geojson.street_features(spark, str(tmp_path / "calles.json")), "name", "direction", "street_type", F.size("line"))
    assert got == [("ALEM", "DOBLE", "", 2), ("MITRE", "CRECIENTE", "AVENIDA", 2)]


def test_csv_tables(spark, tmp_path):
    p = tmp_path / "caps.csv"
    p.write_text('MAX_CONTENEDORES;geometry_wkt\n"3";"LINESTRING (0 0, 1 1)"\n"x";"LINESTRING (0 0, 1 1)"\n"2";"bad"\n')
    assert rows_of(tables.segment_capacities(spark, str(p)), "capacity") == [(3,)]
    p = tmp_path / "plain.csv"
    p.write_text("WKT\n\"LINESTRING (0 0, 1 1)\"\n")
    assert rows_of(tables.segment_capacities(spark, str(p)), "capacity") == [(2,)]
    p = tmp_path / "radios.csv"
    p.write_text(
        "Código de radio,Nombre de departamento,Geometría en WKT,Población total,Población total (en hogares familiares),Superficie en km2\n"
        'A,C1,"POLYGON ((0 0, 1 0, 1 1, 0 0))",120.0,90,0.5\nB,C1,"POLYGON ((0 0, 1 0, 1 1, 0 0))",,90,x\nC,C1,,1,1,1\nD,C1,"POLYGON ((0 0, 1 0, 1 1, 0 0))",?,90,1\n'
    )
    assert rows_of(tables.census_tracts(spark, str(p)), "radio_code", "population", "area_km2") == [("A", 120, 0.5), ("B", 90, 0.0), ("D", 0, 1.0)]
    p = tmp_path / "pop.csv"
    p.write_text("barrio,poblacion\nNúñez,5\n")
    assert rows_of(tables.populations(spark, str(p)), "key", "population") == [("nunez", 5)]
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.populations(spark, str(p))
    p = tmp_path / "routes.csv"
    p.write_text("cod_ruta_d_1,nomoficial_x,alt_izqini,alt_derfin,zona\n1184.000,VIAMONTE,100,199,2\n1184.0,ACU±A,,,\n,SKIP,1,2,1\n77,ALEM,5,x,1\n")
    got = rows_of(tables.route_segments(spark, str(p)), "route_id", "street_name", "alt_start", "alt_end", "zone")
    assert got == [("1184", "ACUñA", 0, 100, 3), ("1184", "VIAMONTE", 100, 199, 2), ("77", "ALEM", 5, 105, 1)]


def test_partitioned_history(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, hour(6 * i), i) for i in range(20)], "id bigint, container_id bigint, reading_date timestamp_ntz, level int")
    path = str(tmp_path / "history")
    facts.write_readings(df, path)
    window = facts.read_window(spark, path, hour(25), hour(60))
    assert rows_of(window, "id") == [(i,) for i in range(5, 11)]
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reading_day" in plan and "PushedFilters: [IsNotNull(reading_date)" in plan
    days = spark.createDataFrame([(date(2026, 1, 1),)], "reading_day date")
    assert facts.drop_days(spark.read.parquet(path), days).count() == 16


def test_reference_load_twice(spark):
    have = spark.createDataFrame([("a",)], "name string")
    seed = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    once = facts.load_reference(have, seed, "name")
    assert rows_of(facts.load_reference(once, seed, "name")) == [("a",), ("b",)]
