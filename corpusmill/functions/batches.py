"""Arrow batches in slices, so that a task's memory does not follow the length of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows with long texts are handled in slices of about this many bytes.
SLICE_BYTES = 2_000_000


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First place and length of each slice."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    place = np.maximum(np.cumsum(lengths) - 1, 0) // SLICE_BYTES
    for cut in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1):
        if len(cut):
            yield int(cut[0]), len(cut)


def sliced(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``SLICE_BYTES`` of column ``text`` or a single row.

    A batch holds as many rows as the session's setting says, however long they are; what is made
    from its rows is larger than the rows.
    """
    for batch in batches:
        for start, rows in _cuts(batch.column(text)):
            yield batch.slice(start, rows)


def sliced_array(texts: pa.Array) -> Iterator[pa.Array]:
    """The same for an array."""
    for start, rows in _cuts(texts):
        yield texts.slice(start, rows)
