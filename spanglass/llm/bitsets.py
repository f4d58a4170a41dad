"""A set of 64-bit keys as a broadcast bit set of fixed size, to drop rows before a shuffle.

It says of a key either that it is not in the set or that it may be; a join then decides.
Its size is a parameter, whatever the number of keys; with very many keys it only drops less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 1 << 27  # 16 MB
_PAGE = 32_768  # bits of one row of bitmap_construct_agg


#: The constants of XXH64, which Spark's xxhash64 computes with seed 42.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = 42


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _places(keys: np.ndarray) -> np.ndarray:
    """The first 27 bits of Spark's xxhash64 of each key."""
    with np.errstate(over="ignore"):
        h = (np.uint64(_SEED) + _P5 + np.uint64(8)) ^ (_turned(keys.view(np.uint64) * _P2, 31) * _P1)
        h = _turned(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(64 - 27)).astype(np.int64)


class KeySet:
    def __init__(self, keys: DataFrame, column: str):
        """From the bigint column of a table; the pages are built by JVM functions on the executors."""

        at = keys.filter(F.col(column).isNotNull()).select(F.shiftrightunsigned(F.xxhash64(F.col(column).cast("bigint")), 64 - 27).alias("at"))
        pages = at.select((F.col("at") / _PAGE).cast("int").alias("page"), (F.col("at") % _PAGE).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
        whole = np.zeros(BITS // 8, np.uint8)
        for r in pages.toLocalIterator():
            whole[r.page * _PAGE // 8 : (r.page + 1) * _PAGE // 8] = np.frombuffer(r.bits, np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(whole)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = _places(np.ascontiguousarray(keys).view(np.int64))
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def filter(self):
        """A function of a bigint column: whether its key may be in the set."""

        @F.arrow_udf(T.BooleanType())
        def may(k: pa.Array) -> pa.Array:
            return pa.array(self.may_hold(k.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))

        return may

    def of_arrays(self):
        """A function of an array<bigint> column: those of its keys that may be in the set."""

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def held(k: pa.Array) -> pa.Array:
            flat, sizes = k.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(k), 0).to_numpy(zero_copy_only=False)
            keep = self.may_hold(flat) if len(flat) else np.zeros(0, bool)
            ends = np.r_[0, np.cumsum(keep)][np.r_[0, np.cumsum(sizes)]]
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[keep], pa.int64()))

        return held

    def __getstate__(self):
        return {"shared": self.shared}
