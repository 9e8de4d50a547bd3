"""Arrow batches of texts, cut so that a task's memory does not follow text lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A slice closes once its texts reach this size; one longer text makes a slice of its own.
SLICE_BYTES = 4 * 1024 * 1024


def text_slices(
    batch: pa.RecordBatch, column: str, slice_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of `batch` with about `slice_bytes` of text each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = int(np.searchsorted(ends, before + slice_bytes, side="right"))
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column, null as empty."""
    return [text or "" for text in batch.column(column).to_pylist()]
