"""Small helpers for Arrow tasks: bounded segments of texts, so memory does not follow the batch size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text and rows worked on at a time; one longer text makes a segment of its own.
SEGMENT, ROWS = 2_000_000, 50_000


def segments(batch: pa.RecordBatch, column: str = "text", limit: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts hold about `limit` bytes."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = sorted({0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), *range(0, batch.num_rows, ROWS), batch.num_rows})
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def frame(columns: dict[str, tuple]) -> pa.RecordBatch:
    """A record batch from name -> (values, type)."""
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()], names=list(columns)
    )
