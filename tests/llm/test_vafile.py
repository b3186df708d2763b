"""Top-k search against comparing everything, its bounds against exact scores."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from binflow.llm import vafile

SF = Path("/root/testdata/sf0.001")
FIELDS = "vec_id long, embedding array<float>, score int, label int"


def whole(v, scale=64):
    v = np.asarray(v, np.float32).astype(float)
    return np.clip(np.floor(scale * v), -vafile.MOST, vafile.MOST).astype(np.int64)


def plain(rows, every, k):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    table = [(i, np.concatenate([whole(v), np.zeros(width - len(v), np.int64)])) for i, v in good]
    out = []
    for i, q in {(i, v.tobytes()): (i, v) for i, v in table if i % every == 0}.values():
        found = sorted((-int(q @ v), j) for j, v in table if j != i)[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


def search(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], FIELDS).repartition(3)
    return sorted(map(tuple, vafile.top_k(frame, **more).select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("width,k,group", [(7, 5, 1 << 20), (64, 20, 4096)])
def test_against_plain(spark, width, k, group):
    rng = np.random.default_rng(width)
    rows = [(i, rng.normal(0, 0.3, width).tolist()) for i in range(500)]
    rows += [(500 + i, [0.25] * width) for i in range(300)]  # one crowded vector
    rows += [(i, rng.choice([-1.0, 1.0], width).tolist()) for i in range(900, 1000)]  # ties
    rows += [(40, rows[3][1]), (60, rows[60][1]), (60, rows[60][1])]  # ids that come again
    rows += [(2000, None), (2020, [float("nan")] + [0.0] * (width - 1)), (2040, [None] * width), (2060, [float("inf")] * width), (None, [0.1] * width)]
    rows += [(3000, [3e38, -3e38] + [0.0] * (width - 2)), (3020, [0.5]), (3021, [])]
    assert search(spark, rows, every=20, k=k, group_bytes=group) == plain(rows, 20, k)


def test_few_rows(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, None), (20, [float("nan")])]) == []
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, [(0, [1.0]), (3, [0.5]), (4, [0.5])]) == [(0, 1, 3, 2048), (0, 2, 4, 2048)]
    assert search(spark, [(0, []), (3, [])]) == [(0, 1, 3, 0)]


def test_bounds_and_reads():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 9, (3000, 32)).astype(np.int64)
    marks = vafile.marks_of(x[:500])
    cells, inside = vafile.cells_of(x, marks)
    assert 0.3 < inside.mean() < 1 and (vafile.wholes(vafile.halves(cells), 32) == cells).all()
    search = vafile.Search(np.arange(50) * 20, x[:1000:20], np.full(50, vafile.NONE), marks, 10)
    low, high = search.low[cells[inside], np.arange(32)], search.high[cells[inside], np.arange(32)]
    assert (low <= x[inside]).all() and (x[inside] <= high).all()
    reads, read = [], search.read
    search.read = lambda q, c, ids, exact: (reads.append(len(q)), read(q, c, ids, exact))
    search.feed(np.arange(3000), cells[inside], inside, x.astype("<i4"))
    assert sum(reads) < 0.35 * 50 * 3000  # of vectors inside the marks only the hopeful are read
    for q in range(50):
        best = sorted((-int(x[q * 20] @ x[j]), j) for j in range(3000) if j != q * 20)[:10]
        assert [(-s, i) for s, i in zip(search.best[1][search.best[0] == q], search.best[2][search.best[0] == q])] == best


@pytest.mark.skipif(not SF.exists(), reason="benchmark tables not present")
def test_query_against_sql(spark):
    from binflow.llm.common import ORACLES, QUERIES

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    frame = QUERIES["op12_top_k"](spark, str(SF))
    want = db.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES['op12_top_k']})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(want) and len(want) == 500
