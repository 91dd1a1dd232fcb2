"""Fixed-size arrays gathered from all rows: tasks send theirs in blocks, which are combined on the cluster by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 12
WAYS = 64


def blocks(values: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Numbers and bytes of the blocks of an array that hold anything."""
    shaped = values.reshape(-1, BLOCK)
    full = np.flatnonzero(shaped.any(axis=1))
    return full.tolist(), [shaped[i].tobytes() for i in full]


def combined(sent: DataFrame, size: int, dtype: str, how: str) -> np.ndarray:
    """Sum or bitwise or of the arrays sent as (block, content); ``size`` values come to the driver.

    Tasks' arrays are combined in ``WAYS`` parts first, by task, so that no task reads what all the others sent of a block.
    """
    numpy_how = {"sum": np.add, "or": np.bitwise_or}[how]

    def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, dtype)
        for b in parts:
            for x in b.column("content"):
                numpy_how(total, np.frombuffer(x.as_buffer(), dtype), out=total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "content"])

    schema = "block int, content binary"
    parts = sent.withColumn("way", F.spark_partition_id() % WAYS).groupBy("block", "way").applyInArrow(run, schema)
    rows = parts.groupBy("block").applyInArrow(run, schema).toArrow()
    out = np.zeros(size, dtype).reshape(-1, BLOCK)
    for block, content in zip(rows.column("block").to_pylist(), rows.column("content")):
        out[block] = np.frombuffer(content.as_buffer(), dtype)
    return out.reshape(-1)


BLOOM_BYTES = 1 << 21
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _bits(keys: np.ndarray) -> np.ndarray:
    return np.stack([(keys * m) >> np.uint64(64 - 24) for m in _MULTIPLIERS])


def bloom(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of 2 MB over a column of longs. With more keys it lets more others pass, never fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(BLOOM_BYTES * 8, bool)
        for b in batches:
            marks[_bits(b.column(0).to_numpy().view(np.uint64)).ravel()] = True
        numbers, content = blocks(np.packbits(marks))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(content, pa.binary())], ["block", "content"])

    return combined(keys.select(F.col(column)).mapInArrow(run, "block int, content binary"), BLOOM_BYTES, "uint8", "or")


def may_hold(filter_bytes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bits(keys)
    return ((filter_bytes[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)
