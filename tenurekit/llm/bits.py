"""A bit table over 64-bit hashes that every task gets: of bounded size whatever is put in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_table(hashes: DataFrame, column: str, bits: int) -> bytes:
    """2**bits bits; the lowest bits of each hash say which is set. At most 2**bits / 64 rows reach the driver."""
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    set_bits = hashes.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
    table = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    for word, bit in set_bits.groupBy("word").agg(F.bit_or("bit")).collect():
        table[word] = bit
    return table.tobytes()


def in_table(hashes: np.ndarray, table: bytes) -> np.ndarray:
    """Which hashes may have been put in; those that were always are."""
    words = np.frombuffer(table, np.uint64)
    slots = hashes & np.uint64(len(words) * 64 - 1)
    return (words[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) > 0
