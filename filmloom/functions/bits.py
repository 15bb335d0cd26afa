"""A bit field of fixed size that tells which 64-bit keys may be among a set of them, whatever its size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 24


def bit_field(keys: DataFrame, column: str = "key") -> np.ndarray:
    """The field of the keys: 2**FILTER_BITS bits (2 MB). NULL keys do not count; no keys give an empty field."""
    bit = F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS)
    words = keys.where(F.col(column).isNotNull()).select(F.shiftright(bit, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("m"))
    field = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for r in words.groupBy("w").agg(F.bit_or("m").alias("m")).collect():  # at most 2**18 rows
        field[r.w] = r.m
    return field.view(np.uint64)


def may_hold(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (uint64) may be in the set: all that are, and a few others by chance."""
    bit = keys >> np.uint64(64 - FILTER_BITS)
    return (field[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
