"""Run registered queries in Spark and their checks in DuckDB and compare rows.

usage: python tools/check_queries.py [--sf DIR] [name part ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from binflow.queries import ORACLES, QUERIES, load  # noqa: E402
from binflow.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((plain(k), plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return repr(value)


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("parts", nargs="*")
    args = parser.parse_args()
    load()
    names = [n for n in QUERIES if not args.parts or any(p in n for p in args.parts)]
    spark = local_session(8)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name in names:
        started = time.time()
        try:
            frame = QUERIES[name](spark, args.sf)
            records = frame.collect()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark {str(error)[:600]}")
            continue
        took = time.time() - started
        if name not in ORACLES:
            print(f"rows  {name}: {len(records)} rows {took:.1f}s")
            continue
        try:
            result = db.execute(ORACLES[name])
            columns = [d[0] for d in result.description]
            expected = result.fetchall()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: duckdb {str(error)[:600]}")
            continue
        if sorted(frame.columns) != sorted(columns):
            bad += 1
            print(f"FAIL  {name}: columns {sorted(frame.columns)} / {sorted(columns)}")
            continue
        ours, theirs = rows_of(records, frame.columns), rows_of(expected, columns)
        if ours == theirs:
            note = "" if ours else "  EMPTY"
            print(f"ok    {name}: {len(ours)} rows {took:.1f}s{note}")
            continue
        bad += 1
        diff = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
        print(f"FAIL  {name}: {len(ours)} / {len(theirs)} rows, sorted columns {sorted(columns)}")
        for a, b in diff:
            print("   spark ", a)
            print("   duckdb", b)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
