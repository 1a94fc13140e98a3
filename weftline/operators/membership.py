"""A Bloom filter of many keys, built by batches and merged in a tree.

It tells for sure that a key is absent; of absent keys it takes about one in a
thousand for present. Keys are pairs of longs that are hashes already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordering import forget, written

#: Bits and probes for each key.
BITS, PROBES = 16, 7
#: Bitmaps that a task merges.
FAN = 16


def _places(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Bits of each key: a row for each probe."""
    a, b = a.view(np.uint64), b.view(np.uint64) | np.uint64(1)
    return (a + np.arange(PROBES, dtype=np.uint64)[:, None] * b) & np.uint64(bits - 1)


def bits_for(n: int) -> int:
    return 1 << max(10, (BITS * n - 1).bit_length())


def bitmap(keys: DataFrame, n: int) -> bytes:
    """The filter of ``n`` keys ``(a, b)``: two bytes or up to four for each."""
    bits = bits_for(n)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = _places(*(c.to_numpy(zero_copy_only=False) for c in b.columns), bits).ravel()
            np.bitwise_or.at(found, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["part", "bits"])

    def merge(some: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in some["bits"]])
        return pa.table({"part": pa.array([some["part"][0].as_py() // FAN], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    level = written(keys.select("a", "b").mapInArrow(fill, "part long, bits binary"))
    while level.count() > 1:
        above = written(level.groupBy(F.expr(f"part div {FAN}")).applyInArrow(merge, "part long, bits binary"))
        forget(level)
        level = above
    one = level.first()
    forget(level)
    return bytes(one["bits"]) if one else bytes(bits // 8)


def may_hold(keys: DataFrame, n: int):
    """A column function from two longs to whether they may be among ``keys``."""
    bits = bits_for(n)
    packed = keys.sparkSession.sparkContext.broadcast(bitmap(keys, n))

    @F.pandas_udf("boolean")
    def asked(a: pd.Series, b: pd.Series) -> pd.Series:
        known = np.frombuffer(packed.value, np.uint8)
        at = _places(a.to_numpy(np.int64), b.to_numpy(np.int64), bits)
        hit = known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)
        return pd.Series(hit.all(axis=0), index=a.index)

    return lambda key: asked(key["a"], key["b"])

