"""Arrow batches of texts in slices, for work that makes Python strings of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are Python strings at one time.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches' rows in views of about SLICE_BYTES of the column's text, one row at least: a batch is cut by rows, however long."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + SLICE_BYTES, side="right")))
            yield b.slice(at, to - at)
            at = to
