"""Sums of a fixed number of hashed counters over all rows.

A task adds up its own counters and passes them on in slices, so that few rows with much in them are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 14
SCHEMA = "slice int, counts binary"


def sliced(counts: np.ndarray) -> pa.RecordBatch:
    """A row for each slice of counts that isn't all zero."""
    grid = counts.reshape(-1, min(SLICE, len(counts))).astype("<i8")
    some = np.flatnonzero(grid.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([grid[k].tobytes() for k in some], pa.binary())], names=["slice", "counts"])


def summed(slices: DataFrame, size: int) -> np.ndarray:
    """The sums of rows made by sliced(), of size counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(blob, "<i8")
                total[k] = total[k] + own if k in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    found = slices.repartition("slice").mapInArrow(run, SCHEMA).toArrow()  # size counters
    out = np.zeros((max(1, size // SLICE), min(SLICE, size)), np.int64)
    for k, blob in zip(found["slice"].to_pylist(), found["counts"].to_pylist()):
        out[k] = np.frombuffer(blob, "<i8")
    return out.ravel()
