"""Arrow batches in parts of bounded text, for the operators that work on texts in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text in a part; one longer text is a part of its own.
PART_BYTES = 4_000_000


def parts(batches: Iterator[pa.RecordBatch], text: int | str = "text", most: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of each batch and their texts."""
    for b in batches:
        col = b.column(text)
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < len(col):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            piece = b.slice(at, to - at)
            yield piece, piece.column(text).to_pylist()
            at = to

