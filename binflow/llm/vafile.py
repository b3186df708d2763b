"""Exact top-k search by inner product over a vector-approximation file.

The file holds for each row its vector and an approximation: the cell of each component, four
bits, between marks taken from a sample. A scan reads the cells and bounds each score from
above; exact vectors are read in the order of their bounds, until the kth score found is above
every bound that is left. Queries go over the file in groups of bounded size. One row in
sixteen is scanned first: the kth score among those is a first limit for all the others, so
tasks give back little more than what is in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binflow.llm.common import query, stored, table
from binflow.llm.vectors import binary, matrix, packed, whole_vectors, width_of

CELLS = 16
#: Bytes of vectors that the marks are taken from; vectors beyond the outer marks have no cell and are read exactly.
SAMPLE_BYTES = 16 << 20
#: Bytes of the queries that go over the file together, as 64-bit numbers.
GROUP_BYTES = 8 << 20
#: One row in so many is scanned first.
SEEDS = 16
#: Components are held within these bounds, so that scores of up to 1024 components are exact.
MOST = 1 << 26
#: Bounds that a step of the scan holds at once, and exact vectors that it reads at once.
BOUNDS, READ = 1 << 21, 1 << 15
#: The limit of a query of which no k scores are known.
NONE = np.iinfo(np.int64).min


def marks_of(sample: np.ndarray) -> np.ndarray:
    """For each component the least values of the cells and, last, the greatest value: about
    equally many of the sample in each cell."""
    edges = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="lower") + 1
    return np.concatenate([sample.min(axis=0)[None], edges, sample.max(axis=0)[None]]).astype(np.int64)


def cells_of(x: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each component, and which rows have one for all of them."""
    cells = np.empty(x.shape, np.uint8)
    for j in range(x.shape[1]):
        cells[:, j] = np.searchsorted(marks[1:-1, j], x[:, j], "right")
    return cells, ((x >= marks[0]) & (x <= marks[-1])).all(axis=1)


def halves(cells: np.ndarray) -> np.ndarray:
    """Two cells in each byte."""
    if cells.shape[1] % 2:
        cells = np.concatenate([cells, np.zeros((len(cells), 1), np.uint8)], axis=1)
    return cells[:, ::2] | cells[:, 1::2] << 4


def wholes(code: np.ndarray, width: int) -> np.ndarray:
    return np.stack([code & 15, code >> 4], axis=2).reshape(len(code), -1)[:, :width]


def build(rows: DataFrame, width: int, marks: np.ndarray) -> DataFrame:
    """The file: (id, seed, code, exact) for (id, v); code is null for a vector outside the marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), width)
            cells, inside = cells_of(x, marks)
            code = pc.if_else(pa.array(inside), binary(halves(cells)), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, binary(x.astype("<i4"))], names=["id", "seed", "code", "exact"])

    seed = F.pmod(F.xxhash64("id"), F.lit(SEEDS)) == 0
    return rows.select("id", seed.alias("seed"), "v").mapInArrow(run, "id bigint, seed boolean, code binary, exact binary")


class Search:
    """The k best candidates so far of each query: higher scores first, then lower ids."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, limit: np.ndarray, marks: np.ndarray, k: int):
        """limit: a score that the kth result of a query can't be below."""
        self.ids, self.queries, self.limit, self.k = ids, queries, limit.copy(), k
        self.low, self.high = marks[:-1], np.concatenate([marks[1:-1] - 1, marks[-1:]])
        self.high = np.maximum(self.high, self.low)
        reach = np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=0)
        most = float((np.abs(queries).astype(float) * reach).sum(axis=1).max()) if len(queries) else 0.0
        self.kind = np.float32 if most < 1 << 24 else np.float64
        # Sums that a double doesn't hold exactly are rounded up by more than their error.
        self.slack = 0.0 if most < 1 << 53 else most * 2.0**-40
        self.sides = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(self.kind)
        empty = np.empty(0, np.int64)
        self.best = (empty, empty, empty)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in zip(self.best, (query, score, ids), strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else q
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last = rank == self.k - 1
        self.limit[q[last]] = np.maximum(self.limit[q[last]], s[last])
        keep = rank < self.k
        self.best = (q[keep], s[keep], i[keep])

    def read(self, query: np.ndarray, at: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        for k in range(0, len(query), READ):
            q, c = query[k : k + READ], at[k : k + READ]
            self.add(q, np.einsum("ij,ij->i", self.queries[q], exact[c].astype(np.int64)), ids[c])

    def some_of_equals(self, ids: np.ndarray, exact: np.ndarray) -> np.ndarray:
        """Of the rows with equal vectors the first by id, as many as results can hold."""
        rows = np.ascontiguousarray(exact).view(np.dtype((np.void, exact.shape[1] * exact.itemsize))).ravel()
        _, same, sizes = np.unique(rows, return_inverse=True, return_counts=True)
        if sizes.max() <= self.k:
            return np.arange(len(ids))
        order = np.lexsort((ids, same))
        rank = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # A query's own rows are none of its results, and an id may be repeated.
        own = np.unique(np.stack([same, ids]), axis=1, return_counts=True)[1].max()
        return np.sort(order[rank < self.k + own])

    def feed(self, ids: np.ndarray, cells: np.ndarray | None, inside: np.ndarray, exact: np.ndarray) -> None:
        """Scan a block of the file. cells: those of the rows inside the marks."""
        keep = self.some_of_equals(ids, exact)
        if len(keep) < len(ids):
            kept = np.zeros(len(ids), bool)
            kept[keep] = True
            cells = cells[kept[inside]]
            ids, inside, exact = ids[keep], inside[keep], exact[keep]
        n, width = exact.shape
        dims = np.arange(width)
        sides = np.zeros((n, 2 * width), self.kind)
        sides[inside, :width] = self.high[cells, dims]
        sides[inside, width:] = self.low[cells, dims]
        step = max(1, BOUNDS // max(1, n))
        for at in range(0, len(self.queries), step):
            bounds = self.sides[at : at + step] @ sides.T
            if self.slack:
                bounds += self.slack
            bounds[:, ~inside] = np.inf
            bounds[self.ids[at : at + step, None] == ids] = -np.inf
            limit = self.limit[at : at + step]
            first = 2 * self.k
            if (limit == NONE).any() and first < n:
                # Nothing is known yet: the best bounds give a limit.
                top = np.argpartition(bounds, n - first, axis=1)[:, n - first :].ravel()
                q = np.repeat(np.arange(len(bounds)), first)
                real = bounds[q, top] > -np.inf
                self.read(q[real] + at, top[real], ids, exact)
                bounds[q, top] = -np.inf
                limit = self.limit[at : at + step]
            q, c = np.nonzero((bounds >= limit[:, None]) & (bounds > -np.inf))
            self.in_order(q + at, c, bounds[q, c], ids, exact)

    def in_order(self, q: np.ndarray, c: np.ndarray, bound: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        """Read exact vectors by falling bound, more in each turn, until no bound reaches the kth score."""
        order = np.lexsort((ids[c], -bound, q))
        q, c, bound = q[order], c[order], bound[order]
        turn = 2 * self.k
        while len(q):
            starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
            now = rank < turn
            self.read(q[now], c[now], ids, exact)
            q, c, bound = q[~now], c[~now], bound[~now]
            left = bound >= self.limit[q]
            q, c, bound = q[left], c[left], bound[left]
            turn *= 2


def _scanned(file: DataFrame, held, width: int, k: int) -> DataFrame:
    """(q, query_id, id, score): the best of each task for the queries of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, limit, marks = held.value
        search = Search(ids, queries, limit, marks, k)
        for batch in batches:
            if batch.num_rows:
                code = batch.column(1)
                inside = np.asarray(code.is_valid())
                cells = wholes(packed(code.drop_null(), np.uint8, (width + 1) // 2), width)
                search.feed(batch.column(0).to_numpy(), cells, inside, packed(batch.column(2), "<i4", width))
        q, s, i = search.best
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids[q]), pa.array(i), pa.array(s)], names=["q", "query_id", "id", "score"])

    return file.select("id", "code", "exact").mapInArrow(run, "q int, query_id bigint, id bigint, score bigint")


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, scale: int = 64, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, `key`, score): the k highest inner products of floor(scale * x) of each
    row whose id is divisible by `every` with all rows of other ids; ties to the smaller id.

    Rows with a null id, a null vector or null or non-finite components take no part. Shorter
    vectors count as filled up with zeros, components beyond 2^26 as 2^26. Equal rows that
    repeat an id are each a candidate, but one query; rows of one id with different vectors are
    a query each. With fewer candidates than k there are fewer ranks, without rows none.
    """
    spark = rows.sparkSession
    valid = whole_vectors(rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL"), "v", scale, MOST)
    width = width_of(valid, "v")
    none = spark.range(0).select(*[F.lit(0).cast(t).alias(c) for c, t in (("query_id", "long"), ("rank", "int"), (key, "long"), ("score", "long"))])
    if not width:
        # Vectors without components have equal scores.
        valid, width = valid.withColumn("v", F.array(F.lit(0).cast("long"))), 1
    sample = valid.orderBy(F.xxhash64("id"), "id").limit(max(CELLS, SAMPLE_BYTES // (8 * width))).select("v").toArrow()
    if not sample.num_rows:
        return none
    marks = marks_of(matrix(sample.column(0).combine_chunks(), width))
    file = stored(build(valid, width, marks))
    queries = stored(file.where(F.col("id") % every == 0).select("id", "exact").distinct())
    groups = -(-queries.count() * width * 8 // group_bytes)
    results = []
    for g in range(groups):
        mine = queries.where(F.pmod(F.xxhash64("id", "exact"), F.lit(groups)) == g).toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        ids = mine.column(0).to_numpy()
        x = packed(mine.column(1).combine_chunks(), "<i4", width).astype(np.int64)
        limit = np.full(len(ids), NONE)
        first = stored(_top(_scanned(file.where("seed"), spark.sparkContext.broadcast((ids, x, limit, marks)), width, k), k))
        kth = first.where(F.col("rank") == k).select("q", "score").toArrow()
        limit[kth.column(0).to_numpy()] = kth.column(1).to_numpy()
        rest = _scanned(file.where("NOT seed"), spark.sparkContext.broadcast((ids, x, limit, marks)), width, k)
        results.append(stored(_top(rest.unionByName(first.drop("rank")), k)))
    found = reduce(DataFrame.unionByName, results) if results else none.select(F.lit(0).alias("q"), "query_id", F.col(key).alias("id"), "score", "rank")
    return found.select("query_id", "rank", F.col("id").alias(key), "score")


SQL = """
WITH v AS (
    SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op12_top_k", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
