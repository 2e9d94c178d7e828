"""Rows packed into blocks of arrays once, and sums over them: what solvers that read the same rows again and again work on."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reach_workers, staged

#: Rows of a block, and rows that a sum over many blocks brings to the driver.
BLOCK_ROWS, SUM_ROWS = 8192, 32
BLOCKS = "x binary, y binary, t binary, n bigint"


class Packed(NamedTuple):
    """BLOCKS in the shared folder, how many there are, and the kind of x."""

    blocks: DataFrame
    count: int
    kind: np.dtype

    def arrays(self) -> Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What reads a block's row as x, y, t."""
        return partial(_arrays, self.kind)


def pack(frame: DataFrame, features: Sequence[Column], target: Column, mark: Column | None = None, kind=np.float64) -> Packed:
    """The rows with a target as blocks of features, target and a number t. A null feature is an error."""
    reach_workers(frame.sparkSession)
    kind = np.dtype(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if any(c.null_count for c in b.columns):
                raise ValueError("features must not be null")
            cols = [c.to_numpy() for c in b.columns]
            x = np.column_stack(cols[:-2]).astype(kind) if len(cols) > 2 else np.zeros((b.num_rows, 0), kind)
            for a in range(0, b.num_rows, BLOCK_ROWS):
                part = slice(a, a + BLOCK_ROWS)
                cells = [np.ascontiguousarray(x[part]).tobytes(), cols[-2][part].tobytes(), cols[-1][part].tobytes(), len(cols[-1][part])]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [*[pa.binary()] * 3, pa.int64()], strict=True)], names=["x", "y", "t", "n"])

    number = F.lit(0.0) if mark is None else mark.cast("double")
    rows = frame.where(target.isNotNull()).select(*(f.cast("double").alias(f"x{k}") for k, f in enumerate(features)), target.cast("double").alias("y"), number.alias("t"))
    blocks = staged(rows.mapInArrow(work, BLOCKS), "packed")
    return Packed(blocks, blocks.count(), kind)


def _arrays(kind: np.dtype, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, t = np.frombuffer(row["y"]), np.frombuffer(row["t"])
    return np.frombuffer(row["x"], kind).reshape(len(y), -1), y, t


def summed(packed: Packed, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of work(x, y, t), an array of `size` numbers: by task, with many blocks then over SUM_ROWS groups of tasks, and on the driver."""

    arrays = packed.arrays()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for b in batches:
            for k in range(b.num_rows):
                total += work(*arrays(b.slice(k, 1).to_pylist()[0]))
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUM_ROWS]), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def group(table: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(x) for x in table.column("total").to_pylist()], axis=0)
        return pa.table({"total": pa.array([whole.tobytes()], pa.binary())})

    parts = packed.blocks.mapInArrow(each, "part bigint, total binary")
    if packed.count > SUM_ROWS:
        parts = parts.groupBy("part").applyInArrow(group, "total binary")
    return np.sum([np.frombuffer(r["total"]) for r in parts.select("total").collect()] or [np.zeros(size)], axis=0)
