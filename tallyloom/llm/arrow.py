"""Helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of an operator handles at a time, so that a task's memory does not follow its batch size.
PART_BYTES = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls are empty."""
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
        column = pc.fill_null(column, b"" if binary else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.empty(0, np.uint8) if data is None or data.size == 0 else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batches: Iterable[pa.RecordBatch], column: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of ``column``; a single longer row is a slice of its own."""
    for batch in batches:
        ends = utf8(batch.column(column))[1][1:]
        start, n, before = 0, batch.num_rows, 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])


def documents(column: pa.Array) -> list[bytes]:
    """Rows of a text column as bytes; nulls are empty."""
    data, offsets = utf8(column)
    whole, at = data.tobytes(), offsets.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])]


def record(arrays: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays.values()], names=list(arrays))


def id_lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    """One list per row from concatenated values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values).cast(kind))
