"""Terms of whole slices of texts: runs of digits, ASCII letters and all that is not ASCII."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# A byte's lower-case form for A-Z; separators become a space.
_INSIDE = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _INSIDE[_low : _high + 1] = True
_FOLDED = np.where(_INSIDE, np.arange(256), 0x20).astype(np.uint8)
_FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)


def folded_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(data, starts, lengths, counts)`` of the terms of all texts, A-Z as a-z.

    ``data`` holds the terms one after the other, each followed by one space, so neighbours of one
    text are joined by one space; ``counts`` says how many terms each text has.
    """
    raw = np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)
    inside = _INSIDE[raw]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, bounds))
    # The byte behind a term is a separator and becomes the space.
    inside[ends] = True
    lengths = ends - starts
    return _FOLDED[raw[inside]], np.append(0, np.cumsum(lengths + 1))[:-1], lengths, counts


def split_terms(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All terms of all texts in order, A-Z as a-z, and how many each text has."""
    data, starts, lengths, counts = folded_terms(texts)
    # Without the spaces behind them terms lie end to end.
    keep = np.ones(len(data), dtype=bool)
    keep[starts + lengths] = False
    ends = np.append(0, np.cumsum(lengths)).astype(np.int64)
    body = pa.py_buffer(np.ascontiguousarray(data[keep]))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), body]), counts
