"""A test of bounded size that tells most rows apart before a join shuffles the others."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap at most: 8 MB, whatever the number of values. Values beyond an eighth of them make it let more through.
MOST_BITS = 1 << 26


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """The bitmap, of at most MOST_BITS, in which each 64-bit value of the one column ``hash`` sets two bits."""
    bits = min(MOST_BITS, 1 << max(10, (8 * hashes.count()).bit_length()))
    places = F.array(F.pmod("hash", F.lit(bits)), F.pmod(F.shiftright("hash", 32), F.lit(bits)))
    at = hashes.select(F.explode(places).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bitmap


def may_hold(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit values ``h`` may be among a bitmap's: all that are, and few others."""
    bits = 64 * len(bitmap)
    out = np.ones(len(h), bool)
    for at in (h % bits, (h >> 32) % bits):
        out &= (bitmap[at >> 6] >> (at & 63)) & 1 == 1
    return out


def possible(values: DataFrame, column: str) -> Callable[[Column], Column]:
    """A function of a column: true wherever the column has one of ``values[column]`` (without nulls), and for few others.

    The values' hashes set bits, two each, of a bitmap that is gathered word by word and broadcast. What it lets through
    has to be joined still; what it doesn't is in no row of ``values``.
    """
    bitmap = bitmap_of(values.select(F.xxhash64(column).alias("hash")))
    held = values.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(may_hold(held.value, hashes.to_numpy(zero_copy_only=False)))

    return lambda c: test(F.xxhash64(c))
