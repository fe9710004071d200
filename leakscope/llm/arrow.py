"""Arrow helpers of the operators that work on batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4_000_000


def small_slices(batches: Iterator[pa.RecordBatch], most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few megabytes; a single long text stays whole."""
    for batch in batches:
        step = max(1, int(len(batch) * most_bytes / max(1, batch.nbytes)))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def list_bounds(column: pa.ListArray) -> np.ndarray:
    """Offsets of a list column into its flattened values, from 0."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0]
