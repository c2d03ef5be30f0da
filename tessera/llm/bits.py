"""Bit tables of fixed size: which hashes a column holds, with chance hits but no misses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of a table, 8 MB; this is what a broadcast of one takes, whatever the column holds.
BITS = 1 << 26
_BUCKET = 32768  # bits of one row of bitmap_construct_agg


def bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """The low bits of a column of longs; at most BITS / 8 bytes come to the driver."""
    slot = F.col(column).bitwiseAND(BITS - 1) + 1  # buckets start at 1
    rows = hashes.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    table = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in rows:
        table[(bucket - 1) * (_BUCKET // 8) : bucket * (_BUCKET // 8)] = np.frombuffer(bytes(bits), np.uint8)
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) the table may hold."""
    slot = (hashes & np.uint64(BITS - 1)).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
