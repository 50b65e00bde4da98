"""A set of 64-bit keys as a table of bits of fixed size: what is small enough to broadcast however many keys there are.

A key that is in the set is always found; others are found by chance, more often the fuller the table. Callers must be right in either case.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe.llm.common import slices

#: Bits of a table: 16 MB.
BITS = 27


def empty() -> np.ndarray:
    return np.zeros(1 << (BITS - 3), np.uint8)


def table(keys: DataFrame, column: str = "key") -> np.ndarray:
    """The table of these keys (longs); the driver gets at most 2 ** (BITS - 6) rows of two numbers."""
    at = F.shiftrightunsigned(column, 64 - BITS)
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - BITS}) & 63 as int))")
    got = keys.groupBy(F.shiftrightunsigned(at, 6).alias("at")).agg(F.bit_or(mask).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[np.asarray(got["at"])] = np.asarray(got["bits"])
    return out.view(np.uint8)


def share(spark: SparkSession, bits: np.ndarray):
    """A broadcast of the table, packed: a table with few keys is small on every disk it reaches."""
    return spark.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))


def load(shared) -> np.ndarray:
    return np.frombuffer(zlib.decompress(shared.value), np.uint8)


def has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key.view(np.uint64) >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def only(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` (long) may be among ``keys`` (its one column, longs): a filter before a join, not instead of it."""
    shared = share(df.sparkSession, table(keys.select(F.xxhash64(keys.columns[0]).alias("key"))))
    where = len(df.columns)

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = load(shared)
        for batch in slices(batches, 1024):
            yield batch.filter(pa.array(has(bits, np.asarray(batch.column(where))))).select(range(where))

    return df.withColumn("__key", F.xxhash64(column)).mapInArrow(take, df.schema)
