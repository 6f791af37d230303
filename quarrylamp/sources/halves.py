"""Vectors stored at half precision: two bytes a component, decoded in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def halved(values: np.ndarray) -> np.ndarray:
    """Values at half precision, ties to even; a finite value beyond its range is an error."""
    with np.errstate(over="ignore"):
        small = values.astype(np.float16)
    beyond = np.isinf(small) & np.isfinite(values)
    if beyond.any():
        raise ValueError(f"{values[beyond][0]} is out of range for half precision")
    return small


def _exchanged(df: DataFrame, column: str, kind: T.DataType, convert) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, kind if f.name == column else f.dataType) for f in df.schema.fields])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            columns[at] = convert(columns[at])
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, schema)


def _packed(vectors: pa.Array) -> pa.Array:
    values = vectors.flatten()
    if values.null_count:
        raise ValueError("a vector with a null component cannot be stored")
    data = halved(values.to_numpy(zero_copy_only=False)).astype("<f2").tobytes()
    sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy()), 0)
    offsets = np.append(0, 2 * np.cumsum(sizes)).astype(np.int32)
    whole = pa.BinaryArray.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.array(whole.to_pylist(), pa.binary(), mask=~vectors.is_valid().to_numpy(zero_copy_only=False)) if vectors.null_count else whole


def _unpacked(packed: pa.Array) -> pa.Array:
    rows = packed.to_pylist()
    data = b"".join(row or b"" for row in rows)
    sizes = np.array([len(row or b"") // 2 for row in rows], np.int64)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    values = pa.array(np.frombuffer(data, "<f2").astype(np.float32))
    missing = pa.array([row is None for row in rows])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=missing if packed.null_count else None)


def pack_halves(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors of a column as bytes, two a component.

    Null vectors stay null and empty ones empty.  A null component and a finite value beyond half
    precision (from 65520 on) are errors.  Other columns stay as they are.
    """
    return _exchanged(df, column, T.BinaryType(), _packed)


def unpack_halves(df: DataFrame, column: str = "embedding") -> DataFrame:
    """The vectors of a packed column, as arrays of floats."""
    return _exchanged(df, column, T.ArrayType(T.FloatType()), _unpacked)
