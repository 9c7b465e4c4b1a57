"""Fixed-size count tables over a corpus, summed slice by slice on the executors."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 32
FAN_IN = 256


def _narrow(table: np.ndarray) -> bytes:
    """The counts in the fewest bytes each that hold the largest."""
    return table.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if t is np.int64 or table.max(initial=0) <= np.iinfo(t).max)).tobytes()


def _wide(blob: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(blob)
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // n]).astype(np.int64)


def summed(rows: DataFrame, size: int, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How often each key below ``size`` occurs in all rows.

    Each task counts into one table of ``size`` numbers; the tables are cut into
    slices, shuffled compressed and added up per slice.  What reaches the driver
    is one table, whatever the input.
    """
    part = size // SLICES

    def count(batches):
        table = np.zeros(size, np.int64)
        for batch in batches:
            for ks in keys(batch):
                if len(ks) * 8 > size:
                    table += np.bincount(ks, minlength=size)
                else:
                    np.add.at(table, ks, 1)
        if table.any():
            bin = TaskContext.get().partitionId() // FAN_IN
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([bin] * SLICES, pa.int32()), pa.array([zlib.compress(_narrow(table[i * part : (i + 1) * part]), 1) for i in range(SLICES)], pa.binary())], ["slice", "bin", "counts"])

    def add(table):
        total = np.zeros(part, np.int64)
        for blob in table["counts"]:
            total += _wide(blob.as_py(), part)
        return pa.table({"slice": table["slice"][:1], "bin": pa.array([table["bin"][0].as_py() // FAN_IN], pa.int32()), "counts": pa.array([zlib.compress(_narrow(total), 1)], pa.binary())})

    # Three rounds, each of at most FAN_IN tables a group, for up to FAN_IN ** 3 tasks.
    schema = "slice int, bin int, counts binary"
    found = rows.mapInArrow(count, schema)
    for _ in range(3):
        found = found.groupBy("slice", "bin").applyInArrow(add, schema)
    out = np.zeros(size, np.int64)
    for i, _, blob in found.collect():
        out[i * part : (i + 1) * part] += _wide(blob, part)
    return out


MOST_BITS = 26
_WORD_BITS = 32_768  # fixed value: how many bits Spark's bitmap functions put in one bitmap


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of the leading parts of the 64-bit hashes in ``column``: 16 for each key, 2**26 in all at most.

    Partial bitmaps are made in Spark's map-side aggregation; the driver gets 8 MB at
    most, whatever the number of keys.  Beyond some 10 million keys more and more
    others share a bit.
    """
    bits = min(MOST_BITS, max(15, (16 * keys.count()).bit_length()))
    cell = F.shiftrightunsigned(column, 64 - bits) + 1  # the functions number bits from 1
    rows = keys.groupBy(F.bitmap_bucket_number(cell).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    step = _WORD_BITS // 8
    for at, found in rows.collect():
        out[(at - 1) * step : at * step] = np.frombuffer(bytes(found), np.uint8)
    return out


def has_bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set: true for all keys of the table, and for some others."""
    cell = (keys.astype(np.uint64) >> np.uint64(64 - (8 * len(table)).bit_length() + 1)).astype(np.int64)
    return (table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
