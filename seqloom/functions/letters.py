"""String columns of Arrow batches as flat arrays of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after the other, and where each string begins. Nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column), np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0]


def latin1_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a character, and where each string begins."""
    data, starts = utf8_bytes(column)
    if not (data >= 0x80).any():
        return data, starts
    rows = [(v or "").encode("latin-1", "replace") for v in column.to_pylist()]
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])[:-1].astype(np.int64)
