"""Sums of equally long arrays that tasks emit in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 14  # values a row

_BLOCKS = pa.schema([("block", pa.int32()), ("data", pa.binary())])
_DDL = "block int, data binary"


def blocked(values: np.ndarray) -> pa.RecordBatch:
    """A task's array as float32 blocks; blocks of zeros are left out."""
    flat = values.astype(np.float32).ravel()
    parts = [(k, flat[i:i + BLOCK]) for k, i in enumerate(range(0, len(flat), BLOCK))]
    parts = [(k, x.tobytes()) for k, x in parts if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()),
                                       pa.array([x for _, x in parts], pa.binary())], schema=_BLOCKS)


def _add(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(x, np.float32)
            if k in sums:
                sums[k] += x
            else:
                sums[k] = x.astype(np.float64)
    for k, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())],
                                         schema=_BLOCKS)


def total(blocks: DataFrame, size: int) -> np.ndarray:
    """The sum over all tasks, float32 of ``size`` values (a fixed model size).

    A block's rows are added as they stream in, so a task holds one row a block.
    """
    out = np.zeros(size, np.float32)
    for k, data in blocks.repartition("block").mapInArrow(_add, _DDL).collect():
        x = np.frombuffer(data, np.float32)
        out[k * BLOCK:k * BLOCK + len(x)] += x
    return out
