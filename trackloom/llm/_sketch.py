"""Counting sketches of a fixed size, whatever the input's size, and so fit to broadcast."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_CELLS = 16384


def blocks(cells: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A task's cells as numbered blocks, those with counts only."""
    parts = cells.astype("<u4").reshape(-1, BLOCK_CELLS)
    some = np.flatnonzero(parts.any(axis=1))
    return pa.array(some.astype(np.int64)), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in some], pa.binary())


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal blocks; rows come sorted by block."""

    def out() -> pa.RecordBatch:
        raw = np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([zlib.compress(raw, 1)], pa.binary())], names=["block", "cells"])

    at, total = None, None
    for batch in batches:
        for k, raw in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(raw), dtype="<u4").astype(np.uint64)
            if k == at:
                total += part
                continue
            if at is not None:
                yield out()
            at, total = k, part
    if at is not None:
        yield out()


def total(parts: DataFrame, n_cells: int) -> np.ndarray:
    """The sum of all tasks' blocks (block, cells): n_cells numbers on the driver, no more."""
    summed = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_add, "block long, cells binary")
    out = np.zeros((n_cells // BLOCK_CELLS, BLOCK_CELLS), dtype=np.uint32)
    for row in summed.toLocalIterator():
        out[row.block] = np.frombuffer(zlib.decompress(row.cells), dtype="<u4")
    return out.reshape(-1)


def classes(cells: np.ndarray) -> np.ndarray:
    """Half powers of two of what a cell holds over its chance load, at most 63: what chance explains is class 0."""
    return np.clip(np.floor(2 * np.log2(np.maximum(over(cells)[0], 0.5))) + 1, 0, 63).astype(np.uint8)


def over(cells: np.ndarray) -> tuple[np.ndarray, float]:
    """What cells hold over the usual, in units of four spreads, and that unit."""
    usual = float(np.median(cells))
    unit = 4 * max(1.0, 1.4826 * float(np.median(np.abs(cells - usual))))
    return (cells - usual) / unit, unit
