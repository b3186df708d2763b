"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

The nearest entry is found by slices and masks. The coordinates of a codebook's entries are
sorted in each dimension, and every place in that order carries the mask of the entries before
it. A radius that surely reaches the nearest entry cuts a range out of each order; the two
prefix masks at its ends give the entries in the range, the masks of all dimensions are
intersected, and only entries that are left are measured. Codebooks are refined in rounds of
partial sums, one small row for each entry and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow import session
from binflow.llm.common import query, stored, table
from binflow.llm.vectors import pack, packed, whole_vectors, width_of

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are held within these bounds, so that squared distances of up to 64 dimensions are exact.
MOST = 1 << 27
#: Vectors that a step works on at once.
STEP = 4096


class Codebook:
    """The entries of one part, with sorted coordinates and prefix masks of each dimension."""

    def __init__(self, entries: np.ndarray):
        n, dims = entries.shape
        self.entries, words = entries, -(-n // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.zeros((n, words), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.order = order
        self.masks = np.zeros((dims, n + 1, words), np.uint64)
        for j in range(dims):
            self.masks[j, 1:] = np.bitwise_or.accumulate(bits[order[:, j]], axis=0)
        # The dimensions that tell entries apart best give the first radius.
        self.guides = np.argsort(-np.ptp(entries, axis=0), kind="stable")[:2]

    def reach(self, x: np.ndarray) -> np.ndarray:
        """A radius within which each row has an entry: its distance to the closest in a guiding dimension."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        for j in self.guides:
            above = np.searchsorted(self.sorted[:, j], x[:, j])
            for at in (np.maximum(above - 1, 0), np.minimum(above, len(self.entries) - 1)):
                away = x - self.entries[self.order[at, j]]
                best = np.minimum(best, np.einsum("ij,ij->i", away, away))
        # One more than the root covers its rounding.
        return np.sqrt(best.astype(np.float64)).astype(np.int64) + 1

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The masks of the entries that lie within the radius in every dimension."""
        found = np.full((len(x), self.masks.shape[2]), np.uint64(2**64 - 1))
        for j in range(x.shape[1]):
            lo = np.searchsorted(self.sorted[:, j], x[:, j] - radius, "left")
            hi = np.searchsorted(self.sorted[:, j], x[:, j] + radius, "right")
            found &= self.masks[j, hi] ^ self.masks[j, lo]
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each row's nearest entry, the lower one of equally near ones, and its squared distance."""
        masks = self.candidates(x, self.reach(x))
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little", count=len(self.entries))
        row, entry = np.nonzero(bits)
        away = x[row] - self.entries[entry]
        away = np.einsum("ij,ij->i", away, away)
        starts = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(away, starts)
        first = np.where(away == least[row], entry, len(self.entries))
        return np.minimum.reduceat(first, starts), least


def assigned(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's parts."""
    parts = x.reshape(len(x), len(books), -1)
    index, away = np.empty((len(x), len(books)), np.int64), np.empty((len(x), len(books)), np.int64)
    for p, book in enumerate(books):
        for at in range(0, len(x), STEP):
            index[at : at + STEP, p], away[at : at + STEP, p] = book.nearest(parts[at : at + STEP, p])
    return index, away


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: `books` (part, entry, dimension) with each entry in the middle of its parts.

    vectors: (v) packed. Tasks give sums of each entry's parts; the driver gets one number for
    each entry and dimension.
    """
    held = vectors.sparkSession.sparkContext.broadcast(books)
    parts, entries, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in held.value]
        sums, sizes = np.zeros((parts * entries, dims), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = packed(batch.column(0), "<i4", parts * dims).astype(np.int64)
            cell = assigned(x, tables)[0] + np.arange(parts) * entries
            sizes += np.bincount(cell.ravel(), minlength=len(sizes))
            order = np.argsort(cell.ravel(), kind="stable")
            flat, at = x.reshape(-1, dims)[order], cell.ravel()[order]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums[at[starts]] += np.add.reduceat(flat, starts, axis=0)
        place = np.arange(parts * entries * dims)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.ravel()), pa.array(np.repeat(sizes, dims))], names=["place", "s", "n"])

    found = vectors.mapInArrow(run, "place bigint, s bigint, n bigint").groupBy("place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = books.copy().ravel()
    for r in found.where("n > 0").collect():
        out[r["place"]] = r["s"] // r["n"]
    return out.reshape(books.shape)


def compressed(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(`key`, code, error, label_error, codebooks_sha256) of each row with a whole vector.

    Rows with a null vector or null or non-finite components are left out. Shorter vectors, and
    a length that the parts don't divide, count as filled up with zeros; components beyond
    2^27 as 2^27. The first entries are the rows with the least ids, equal ids by their
    vectors, a null id last; with fewer rows there are fewer entries. Repeated rows stay.
    label_error is the sum of the errors under a row's label, rows without one together.
    """
    spark = rows.sparkSession
    valid = whole_vectors(rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")), "v", scale, MOST)
    width = max(parts, -(-width_of(valid, "v") // parts) * parts)
    vectors = stored(pack(valid, "v", width))
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    kind = rows.schema[key].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"{key} {kind}, code string, error long, label_error long, codebooks_sha256 string")
    start = np.frombuffer(b"".join(bytes(r["v"]) for r in first), "<i4").astype(np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = refined(vectors.select("v"), books)
    held, digits = spark.sparkContext.broadcast(books), max(2, len(f"{entries - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in held.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            index, away = assigned(packed(batch.column(2), "<i4", width).astype(np.int64), tables)
            codes = ["".join(f"{e:0{digits}x}" for e in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes), pa.array(away.sum(axis=1))], names=["id", "label", "code", "error"])

    kinds = f"id {kind}, label {rows.schema[label].dataType.simpleString()}"
    coded = stored(vectors.mapInArrow(run, f"{kinds}, code string, error bigint"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    named = coded.join(session.small(stored(sums)), F.col("label").eqNullSafe(F.col("of")))
    return named.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other: parts, their nearest entries, the new entries."""
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) AS r(p)
), book0 AS MATERIALIZED (
    SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {ENTRIES}
)"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY away, e) AS turn FROM (
            SELECT vec_id, label, parts.p, x, e, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)]) AS away
            FROM parts JOIN book{k} ON parts.p = book{k}.p
        )
    ) WHERE turn = 1
)""")
        if k < ROUNDS:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
        SELECT p, e, list(m ORDER BY i) AS c FROM (
            SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m
            FROM near{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, e, i
        ) GROUP BY p, e
    ) m ON b.p = m.p AND b.e = m.e
)""")
    return f"""WITH {', '.join(steps)}, coded AS (
    SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(away) AS BIGINT) AS error
    FROM near{ROUNDS} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded
"""


@query("op13_vector_codes", _sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))
