"""Training rows as written blocks of NumPy arrays, for fits that pass over them many times (M3-M6).

A fit of hundreds of short passes pays for each pass's planning and for handing over its rows one by one.  So the rows
are written once, some ten thousand to a block, and the passes run over the blocks as an RDD that Spark keeps in
memory, or on disk where memory is short; a lost partition is read again from the written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from riskframe.session import scratch_path

ROWS = 1 << 16
#: Bytes of a row group, which a task holds while it writes and while it reads.
GROUP_BYTES = 1 << 23
SCHEMA = "block long, n int, x binary, y binary, rest binary"
#: Vectors of all tasks are added on the driver below so many bytes, in the tasks beyond.
ADDED_HERE = 1 << 25


def gathered(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """The batches as tables of ``rows`` rows, the last one with the rest."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, rows - n)
            b = b.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def row(block: int, n: int, x: np.ndarray, y: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([n], pa.int32()), *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
                                                                                        for v in (x, y, rest)]], names=["block", "n", "x", "y", "rest"])


def in_blocks(df: DataFrame, encode: Callable[[np.ndarray], np.ndarray], rest: Callable[[int, pa.Table], np.ndarray],
              rows: int = ROWS) -> DataFrame:
    """The rows (x ARRAY<DOUBLE>, y DOUBLE, ...) as blocks of ``rows``: ``encode`` turns a block's matrix into what is kept of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        for k, t in enumerate(gathered(batches, rows)):
            t = t.combine_chunks()
            x = t["x"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            yield row(first + k, t.num_rows, encode(x), t["y"].to_numpy(), rest(t.num_rows, t))
    return df.mapInArrow(run, SCHEMA)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    # a block is one value of a row: without these, writer and reader hold a hundred and more of them at once
    df.write.option("parquet.page.size.row.check.min", 1).option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(SCHEMA).parquet(path), path


def kept(df: DataFrame, decode: Callable, tasks: int) -> RDD:
    """The decoded blocks in ``tasks`` partitions at most; ``unpersist`` them when the fit is over."""
    return df.coalesce(tasks).rdd.map(decode).persist(StorageLevel.MEMORY_AND_DISK)


def added(vectors: RDD, size: int, here: int = ADDED_HERE) -> np.ndarray:
    """Sum of the tasks' vectors of ``size`` numbers."""
    if vectors.getNumPartitions() * 8 * size <= here:
        return np.sum(vectors.collect(), axis=0)
    return vectors.treeReduce(np.add)
