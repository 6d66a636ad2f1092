"""Small helpers shared by the Arrow stages of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """list<long> with row i = values[offsets[i]:offsets[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64, copy=False)))


def fixed_lists(table: np.ndarray) -> pa.Array:
    """list<long> of the rows of a matrix."""
    rows, width = table.shape
    return long_lists(table.reshape(-1), np.arange(rows + 1) * width)


def sliced(batches, rows: int = 2000, size: int = 8_000_000):
    """The batches cut to at most ``rows`` rows and, but for single rows, ``size`` bytes, so that a stage's working arrays stay small."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.nbytes > size and part.num_rows > 1:
                part = part.slice(0, max(1, min(part.num_rows // 2, part.num_rows * size // part.nbytes)))
            yield part
            at += part.num_rows
