"""Vector codes against measuring every entry."""

import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from binflow.llm import codes

SF = Path("/root/testdata/sf0.001")
FIELDS = "vec_id long, embedding array<float>, label int, code string, v int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    good = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    width = -(-max((len(v) for _, v, _ in good), default=1) // parts) * parts or parts
    table = []
    for i, v, l in good:
        x = [min(codes.MOST, max(-codes.MOST, int(np.floor(scale * float(np.float32(c)))))) for c in v]
        table.append((i, x + [0] * (width - len(x)), l))
    w = width // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(x, p) for _, x, _ in sorted(table, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, x, _ in table:
                members.setdefault(near(cut(x, p), books[p])[1], []).append(cut(x, p))
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else old for e, old in enumerate(books[p])]
    found = []
    for i, x, l in table:
        best = [near(cut(x, p), books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), l))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sum(f[2] for f in found if f[3] == l), digest) for i, c, e, l in found), key=str)


def coded(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], FIELDS).repartition(3)
    return sorted((tuple(r) for r in codes.compressed(frame, **more).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_against_plain(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 24).tolist(), int(i) % 3 if i % 5 else None) for i in range(150)]
    rows += [(200 + i, [0.125] * 24, 1) for i in range(80)] + [rows[7], (7, rows[9][1], 2), (None, rows[3][1], None)]
    rows += [(300, None, 1), (301, [float("nan")] * 24, 1), (302, [None] + [0.0] * 23, 1), (303, [0.5] * 5, 1), (304, [3e38, -3e38] * 12, 2), (305, [], 2)]
    assert coded(spark, rows) == plain(rows)


def test_small_tables(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    for rows in ([(3, [0.5, -0.25], None)], [(i, [0.1 * i] * 9, 0) for i in range(5)], [(i, [], 0) for i in range(3)]):
        assert coded(spark, rows) == plain(rows)


@pytest.mark.parametrize("entries,dims", [(1, 3), (16, 8), (64, 5), (100, 4), (200, 2)])
def test_masks(entries, dims):
    rng = np.random.default_rng(entries)
    book = rng.integers(-50, 50, (entries, dims))
    book[entries // 2] = book[0]
    x = np.concatenate([rng.integers(-80, 80, (3000, dims)), book])
    away = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    index, least = codes.Codebook(book).nearest(x)
    assert (index == away.argmin(axis=1)).all() and (least == away.min(axis=1)).all()
    # The masks hold just the entries of the box.
    radius = rng.integers(0, 60, len(x))
    masks = codes.Codebook(book).candidates(x, radius)
    inside = (np.abs(x[:, None] - book[None]) <= radius[:, None, None]).all(axis=2)
    bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :entries]
    assert (bits == inside).all()


@pytest.mark.skipif(not SF.exists(), reason="benchmark tables not present")
def test_query_against_sql(spark):
    from binflow.llm.common import ORACLES, QUERIES

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    frame = QUERIES["op13_vector_codes"](spark, str(SF))
    want = db.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES['op13_vector_codes']})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(want) and len(want) == 500
