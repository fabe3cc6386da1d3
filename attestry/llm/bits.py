"""Bit tables: a bounded set of hashes that travels to every task, which says "surely not in" or "perhaps in"."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a counted row, and the least and greatest number of 64-bit words; beyond the greatest a table only screens less.
BITS_A_ROW = 16
BLOOM_WORDS = 1 << 12, 1 << 21


def power_of_two(least: int, wanted: float, most: int) -> int:
    return min(most, max(least, 1 << math.ceil(math.log2(max(wanted, 1)))))


def bit_table(rows: DataFrame, hashed: Column):
    """A broadcast bit table, one bit for each row, at the top bits of a hash: its size is bounded by BLOOM_WORDS."""
    size = power_of_two(BLOOM_WORDS[0], rows.count() * BITS_A_ROW / 64, BLOOM_WORDS[1])
    at = rows.select(F.shiftrightunsigned(hashed, 59 - size.bit_length()).alias("h")).groupBy(F.shiftright("h", 6).alias("word"))
    got = at.agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63))")).alias("bits")).toArrow()
    full = np.zeros(size, np.int64)
    full[got["word"].to_numpy()] = got["bits"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(full)


def in_table(held, hashed: np.ndarray) -> pa.Array:
    h = (hashed.view(np.uint64) >> np.uint64(59 - len(held.value).bit_length())).astype(np.int64)
    return pa.array(((held.value[h >> 6] >> (h & 63)) & 1).astype(bool))
