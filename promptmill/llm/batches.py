"""Helpers for functions that run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text handled at once inside a task; a single longer text is still handled whole.
SLICE_BYTES = 8 << 20
SLICE_ROWS = 1 << 15


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with about ``most`` bytes of text and ``SLICE_ROWS`` rows at most."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    turns = np.diff(part) | np.diff(np.arange(batch.num_rows) // SLICE_ROWS)
    edges = [0, *(np.flatnonzero(turns) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, null as the empty text."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def joined_bytes(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts with a line feed after each, and where each begins (one more entry than texts)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + 1, out=starts[1:])
    return b"\n".join(texts) + b"\n" if texts else b"", starts


def list_array(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """A list column with ``sizes[i]`` consecutive values in row i."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
