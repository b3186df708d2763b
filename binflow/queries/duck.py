"""DuckDB text of the derived tables and of the rounding rules, for the checks."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "readings": (
        (),
        "SELECT event_id AS id, user_id AS container_id, user_id // 3 AS site_id, ts AS reading_date,"
        " CAST(LEAST(FLOOR(value), 100) AS INTEGER) AS level, event_type = 'purchase' AS collected FROM events",
    ),
    "long_readings": (
        (),
        "SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey * 3 + l_linenumber % 3 AS container_id,"
        " l_suppkey AS site_id, l_shipdate AS reading_date, CAST(l_quantity * 2 AS INTEGER) AS level,"
        " l_returnflag = 'R' AS collected FROM lineitem",
    ),
    "sites": (
        (),
        "SELECT s_suppkey AS id, 'Sitio RSU - ' || s_name AS name,"
        " 'AV. LINEA ' || chr(CAST(65 + s_suppkey // 10 % 26 AS INTEGER)) || chr(CAST(65 + s_suppkey // 260 % 26 AS INTEGER)) || ' ' || (100 + s_suppkey % 10) AS address,"
        " -34.70e0 + (s_suppkey % 25) * 4e-3 AS latitude, -58.53e0 + (s_suppkey // 25) * 5e-3 AS longitude,"
        " CASE s_suppkey % 3 WHEN 0 THEN 'IZQUIERDA' WHEN 1 THEN 'DERECHA' ELSE 'BILATERAL' END AS load_side_category,"
        " CASE WHEN s_suppkey % 23 = 22 THEN NULL WHEN s_suppkey % 4 = 3 THEN 2 ELSE 1 END AS waste_type_id,"
        " 1 + s_suppkey % 4 AS container_type_id, CAST(s_nationkey AS BIGINT) AS neighborhood_id,"
        " CASE WHEN s_suppkey % 41 = 40 THEN TIMESTAMP '2024-01-20 00:00:00' END AS deleted_at FROM supplier",
    ),
    "containers": (
        ("readings",),
        "SELECT container_id AS id, container_id // 3 AS site_id, 'red|' || (5000 + container_id) AS serie_id,"
        " 'imei-' || container_id AS device_imei,"
        " 'LINEA ' || chr(CAST(65 + container_id // 30 % 26 AS INTEGER)) || ' ' || (100 + container_id // 3) AS address,"
        " -34.70e0 + (container_id // 3 % 25) * 4e-3 + (container_id % 3) * 1e-4 AS latitude,"
        " -58.53e0 + (container_id // 3 // 25) * 5e-3 + (container_id % 2) * 1e-4 AS longitude,"
        " arg_max(r.level, (r.reading_date, r.id)) AS current_level, max(r.id) AS change_version,"
        " container_id % 7 <> 0 AS available, max(CASE WHEN r.collected THEN r.reading_date END) AS last_pickup,"
        " max(r.reading_date) AS last_reading, 1 + container_id // 3 % 4 AS container_type_id,"
        " container_id % 25 AS neighborhood_id,"
        " CASE WHEN container_id % 29 = 11 THEN TIMESTAMP '2024-01-25 00:00:00' END AS deleted_at"
        " FROM readings r GROUP BY container_id",
    ),
    "container_types": (
        (),
        "SELECT * FROM (VALUES (1, 'Lateral Fracción Húmeda', 150, 3.2e0), (2, 'Bilateral Fracción Húmeda', 160, 4e0),"
        " (3, 'Soterrado Fracción Húmeda', 200, 5e0), (4, 'Lateral Fracción Seca', 150, 3.2e0)) t(id, name, height_cm, volume_m3)",
    ),
    "waste_types": (
        (),
        "SELECT * FROM (VALUES (1, 'Fracción Húmeda', '#333333'), (2, 'Fracción Seca', '#00aa00')) t(id, name, color)",
    ),
    "neighborhoods": (
        (),
        "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS commune,"
        " CAST(1000 * (1 + n_nationkey % 9) AS BIGINT) AS population,"
        " CAST(5e-1 + n_nationkey % 4 AS DOUBLE) AS area_km2 FROM nation",
    ),
    "active": (("containers",), "SELECT * FROM containers WHERE deleted_at IS NULL"),
    "live_sites": (("sites",), "SELECT * FROM sites WHERE deleted_at IS NULL"),
    "site_levels": (
        ("live_sites", "active"),
        "SELECT s.id AS site_id, coalesce(avg(c.current_level), 0e0) AS avg_level, count(c.id) AS container_count"
        " FROM live_sites s LEFT JOIN active c ON c.site_id = s.id GROUP BY s.id",
    ),
}


def add_cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (tuple(needs.split()), body)


def with_ctes(names: str, body: str) -> str:
    """`body` after a WITH list of `names` and whatever they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in names.split():
        visit(name)
    head = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in ordered)
    return f"WITH {head}\n{body}"


def half_up(e: str, digits: int) -> str:
    return f"CAST(round(CAST(CAST(({e}) AS DOUBLE) AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def half_even(e: str, digits: int) -> str:
    scaled = f"CAST(CAST(({e}) AS DOUBLE) AS DECIMAL(28,10)) * {10 ** digits}"
    return (
        f"(list_transform([{scaled}], lambda s: CASE WHEN s - floor(s) < 0.5 THEN floor(s)"
        f" WHEN s - floor(s) > 0.5 OR floor(s) % 2 <> 0 THEN floor(s) + 1 ELSE floor(s) END)[1] / {10 ** digits}e0)"
    )


HAVERSINE = (
    "2 * 6371e0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
    " + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"
)


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return HAVERSINE.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


def category(level: str) -> str:
    return (
        f"CASE WHEN {level} >= 80 THEN 'critical' WHEN {level} >= 70 THEN 'high'"
        f" WHEN {level} >= 40 THEN 'normal' WHEN {level} > 0 THEN 'low' ELSE 'idle' END"
    )
