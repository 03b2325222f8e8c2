"""Rows that have one of many keys, told apart without a shuffle of the others.

Few keys go to every task. Of more, tasks get a table of bits: a row whose bits are not set has none of the keys and stays where it is; only the others
meet the keys in a join. A table has a bounded size; with very many keys it says less, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Keys that every task gets as they are.
FEW = 100_000
#: Bits of a table for each key, and the binary logarithms of the least and most bits of one: 32 MB.
EACH, LEAST_BITS, MOST_BITS = 16, 16, 28


def turned(h: Column) -> Column:
    """A hash with its halves exchanged, whose first and last bits are others."""
    return F.shiftleft(h, 32).bitwiseOR(F.shiftrightunsigned(h, 32))


def table_of(hashes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The bits of ``n`` 64-bit ``hashes`` (the only column), two for each, and the binary logarithm of their number; combined before they reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (EACH * n - 1).bit_length() if n else 0))
    h = F.col(hashes.columns[0])
    both = hashes.select(F.explode(F.array(h, turned(h))).alias("h"))
    slot = F.shiftrightunsigned("h", 64 - (bits - 6)).alias("slot")
    found = both.groupBy(slot).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out, bits


def set_in(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    one = lambda x: (table[(x >> np.uint64(64 - (bits - 6))).astype(np.int64)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)
    out = one(h)
    some = h[out]
    out[out] = one(some << np.uint64(32) | some >> np.uint64(32))
    return out


def perhaps(hashes: DataFrame, n: int) -> Callable[[Column], Column]:
    """Whether a hash may be one of ``hashes``: true for all of these, and for few others."""
    table, bits = table_of(hashes, n)
    sent = hashes.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(BooleanType())
    def asked(h: pd.Series) -> pd.Series:
        return pd.Series(set_in(sent.value, bits, h.to_numpy(np.int64).view(np.uint64)))

    return asked


def listed(rows: DataFrame, hashes: DataFrame, n: int) -> DataFrame:
    """``id, key``: those ``keys`` (a list of hashes) of each row (id, keys) that may be one of ``hashes``."""
    table, bits = table_of(hashes, n)
    sent = hashes.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), dtype=np.int64)
            keys = np.asarray(lists.flatten(), dtype=np.int64)
            on = np.flatnonzero(set_in(sent.value, bits, keys.view(np.uint64)))
            row = np.repeat(np.arange(len(size)), size)[on]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(keys[on])], names=["id", "key"])

    return rows.select("id", "keys").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, key long")


def split(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` without and with those that have one of ``keys``, whose columns are the key. Both frames are read more than once, so they should be kept."""
    on = keys.columns
    n = keys.count()
    if n <= FEW:
        keys = F.broadcast(keys)
        return rows.join(keys, on, "left_anti"), rows.join(keys, on, "left_semi")
    may = perhaps(keys.select(F.xxhash64(*on)), n)(F.xxhash64(*on))
    marked = rows.withColumn("__may", may)
    near, far = marked.where("__may").drop("__may"), marked.where(~F.col("__may")).drop("__may")
    return far.unionByName(near.join(keys, on, "left_anti").select(*rows.columns)), near.join(keys, on, "left_semi").select(*rows.columns)
