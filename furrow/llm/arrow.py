"""Arrow batches as NumPy arrays: the bytes of all texts of a batch, end to end."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one uint8 array, and the n + 1 offsets of its texts. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded(batches: Iterable[pa.RecordBatch], column: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes (of lists: items) of ``column``; a longer one is a slice of its own."""
    for batch in batches:
        length = pc.list_value_length if pa.types.is_list(batch.column(column).type) else pc.binary_length
        lengths = pc.fill_null(length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def own_names(*names: str) -> list[str]:
    """Column names that no table has: each with an ending of its own."""
    return [f"{name}_{uuid4().hex}" for name in names]


def added(df: DataFrame, **columns: T.DataType) -> T.StructType:
    """Schema of ``df`` with ``columns`` at its end; columns of those names are replaced."""
    fields = [f for f in df.schema.fields if f.name not in columns]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in columns.items()])


def with_added(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(n) for n in kept), *columns.values()], names=[*kept, *columns]
    )


def byte_texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from its bytes."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, buffers[1], buffers[2]).cast(pa.string())
