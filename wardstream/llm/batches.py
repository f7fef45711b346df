"""Arrow batches hold a fixed number of rows, whatever their size; work on texts goes by characters instead."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters of text that are worked on at once (one longer text goes alone).
SLICE_CHARS = 8_000_000


def slices(sizes: np.ndarray, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes sum to at most ``most``, or of one row."""
    ends, at = np.cumsum(np.asarray(sizes, dtype=np.int64)), 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to
