"""Packed exchange of 64-bit names: a block of rows sends each reducer one sorted array, not one row per name.

A block is a stretch of an input partition (its id: partition, running number). Names go to reducers by their high bits; what
reducers find goes back by block. Sorted names travel as byte planes of their differences, which block compression shrinks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each exchange carries these columns: reducer (or block), kind of content, block, and arrays.
SCHEMA = "to int, kind int, block bigint, a binary, b binary, c binary"


def planes(x: np.ndarray) -> bytes:
    """Byte planes of an unsigned or signed integer array."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() if len(x) else b""


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel() if data else np.zeros(0, dtype)


def pack_sorted(names: np.ndarray) -> bytes:
    return planes(np.diff(names, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def reducer_of(names: np.ndarray, reducers: int) -> np.ndarray:
    """Reducer by the high 32 bits: sorted names fall into consecutive ranges."""
    return ((names >> np.uint64(32)) * np.uint64(reducers)) >> np.uint64(32)


def cuts(names: np.ndarray, reducers: int) -> np.ndarray:
    """Where each reducer's range of sorted names begins (one more than reducers)."""
    return np.searchsorted(reducer_of(names, reducers), np.arange(reducers + 1))


def n_reducers(df: DataFrame) -> int:
    """As many as shuffle partitions or input partitions, whichever is more: a reducer's share stays near a partition's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def exchange(df: DataFrame, reducers: int) -> DataFrame:
    """Rows with one `to` meet in one task, in order of block, so reruns see the same order."""
    return df.repartitionById(reducers, F.col("to")).sortWithinPartitions("to", "block", "kind")


def home(block: int, reducers: int) -> int:
    """The task to which what belongs to a block returns."""
    return ((block * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32) % reducers


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["to", "kind", "block", "a", "b", "c"])


def in_batches(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about `most` bytes, so neither side of the worker's pipe holds a whole block at once."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row[3:]))
        if size >= most:
            yield to_batch(held)
            held, size = [], 0
    if held:
        yield to_batch(held)


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The (kind, a, b, c) rows of each block; rows come in order of block."""
    block, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            _, kind, of, a, b, c = (x[i].as_py() for x in batch.columns)
            if of != block:
                if held:
                    yield block, held
                block, held = of, []
            held.append((kind, a, b, c))
    if held:
        yield block, held
