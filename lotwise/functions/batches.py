"""Arrow batches in portions: a batch has many rows, whose texts may be long."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text worked on at once. What Python or numpy makes of it takes about 40 times as much.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str | int, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``budget`` bytes; a longer text comes alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    start, rows = 0, batch.num_rows
    while start < rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + budget, "right")))
        yield batch.slice(start, end - start)
        start = end
