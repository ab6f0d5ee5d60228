"""Arrow batches cut by the size of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
MOST = 1 << 20


def cut(batches: Iterator[pa.RecordBatch], column: str, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes in ``column``, so that what a task makes of them stays small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            end = max(int(np.searchsorted(ends, before + most, side="right")), at + 1)
            yield batch.slice(at, end - at)
            at = end
