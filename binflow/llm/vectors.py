"""Vectors as whole numbers, packed for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(rows: DataFrame, vector: str, scale: int, most: int) -> DataFrame:
    """The rows of `rows` with a vector of finite components, which becomes floor(scale * x) of
    each component x, held within -most and most."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    scaled = F.transform(vector, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * float(scale)))).cast("bigint"))
    return rows.where(F.col(vector).isNotNull() & finite).withColumn(vector, scaled)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """One int64 row for each list of `column`; shorter lists are filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def packed(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """The rows of a binary column of equally long values."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def binary(values: np.ndarray) -> pa.Array:
    """Each row of `values` as bytes."""
    values = np.ascontiguousarray(values)
    size = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int64) * size
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def pack(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """`rows` with the whole-number vectors as little-endian 32-bit integers, `width` of them."""
    at = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = binary(matrix(columns[at], width).astype("<i4"))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    fields = ", ".join(f"`{f.name}` {'binary' if f.name == vector else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, fields)


def width_of(rows: DataFrame, vector: str) -> int:
    """The longest vector's number of components; 0 without rows."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0
