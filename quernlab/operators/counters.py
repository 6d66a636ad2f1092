"""Counters of fixed size for the n-grams of a whole table, and the rare ends of sets by them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: 2**22 counters of 4 bytes; the array, of that size whatever the table's, is what gets broadcast.
COUNTER_BITS = 22
#: Counters move in blocks of 2**16.
BLOCK = 16
SCHEMA = "block int, counts binary"


def slots(values: np.ndarray, bits: int = COUNTER_BITS) -> np.ndarray:
    """The counter of each 64-bit hash; several hashes may share one."""
    return (values.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def blocks(counts: np.ndarray):
    """(block, counts) as record batches, without blocks of zeros."""
    for block, part in enumerate(np.split(counts, len(counts) >> BLOCK)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(counts, np.int32)
            total[block] = total[block] + part if block in total else part
    for block, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["block", "counts"])


def collected(parts: DataFrame, bits: int = COUNTER_BITS) -> np.ndarray:
    """The sums of (block, counts) rows of all tasks: one array of 2**bits counters."""
    sums = parts.select("block", "counts").repartition(min(32, 1 << (bits - BLOCK)), "block").mapInArrow(_summed, SCHEMA)
    total = np.zeros(1 << bits, np.int32)
    for row in sums.toLocalIterator():  # 2**(bits - 16) rows of 256 KB
        total[row["block"] << BLOCK : (row["block"] + 1) << BLOCK] = np.frombuffer(row["counts"], np.int32)
    return total


def rare_ends(values: np.ndarray, offsets: np.ndarray, counts: np.ndarray, similarity: float, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of the rarest members of each set, in one order for all sets.

    Two sets of the similarity share ``needed`` of the |S| - ceil(t |S|) + needed rarest members of
    each, or as many as they must have in common at all.
    """
    n, bits = np.diff(offsets), len(counts).bit_length() - 1
    doc = np.repeat(np.arange(len(n)), n)
    values = values[np.lexsort((values, counts[slots(values, bits)], doc))]
    overlap = np.ceil(similarity * n - 1e-9).astype(np.int64)
    length = n - overlap + np.minimum(needed, overlap)
    at = np.arange(len(values)) - np.repeat(offsets[:-1], n)
    return values[at < np.repeat(length, n)], np.concatenate([[0], np.cumsum(length)])
